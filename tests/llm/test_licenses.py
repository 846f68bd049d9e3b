import pytest

from orrery.llm import licenses

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_families(spark, model):
    texts = {
        1: ("foo bar\nLicensed under the Apache License, Version 2.0 (the \"License\");\nbaz", "Apache-2.0"), 2: ("Released under the MIT License.", "MIT"), 3: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        4: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), 5: ("Licensed under CC BY-SA 4.0.", "CC-BY-SA"), 6: ("The licence plate of the car was stolen", "unknown"), 7: ("nothing of the kind", None), 8: (None, None), 9: ("", None),
    }
    df = spark.createDataFrame([(k, t, "c") for k, (t, _) in texts.items()], "doc_id long, text string, license string")
    assert {r.doc_id: r.license for r in licenses.scan(df, model).collect()} == {k: v for k, (_, v) in texts.items()}


def test_data(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in licenses.scan(docs, model).collect()}
    notice = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    for r in docs.collect():
        for line, family in notice.items():
            if line in r.text.split("\n"):
                assert family in out[r.doc_id].licenses
    assert len(out) == docs.count()


def test_native_and_odd_rows(odd, none, model):
    out = licenses.scan(odd("probability", "pairs"), model)
    plan = out._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan and "MapInArrow" not in plan
    assert out.count() == 9 and out.where("license is not null").count() == 0
    assert licenses.scan(none, model).count() == 0
    assert 0.5 <= licenses.train(none).threshold <= 1.01


def test_wrapped_notices(spark):
    """Every long template is found when it is wrapped at 60 to 76 columns among other lines, bare or behind comment marks."""
    import textwrap

    prose = "the weather of the day was mild and people walked along the river"
    rows, true = [], {}
    for family, texts in licenses.TEMPLATES.items():
        for text in (x for x in texts if len(x) > 120):
            for width, mark in ((60, ""), (76, "# "), (70, " * ")):
                k = len(rows)
                rows.append((k, "\n".join([prose, *(mark + x for x in textwrap.wrap(text, width)), mark + prose])))
                true[k] = family
    rows += [(1000 + k, f"{prose}\nthe licence of line {k} was revoked by the council\n{prose}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.train(spark.createDataFrame([(k, f"{prose} number {k}\nlast line {k} of {prose}") for k in range(300)], "doc_id long, text string"))
    out = {r.doc_id: r.license for r in licenses.scan(docs, model).collect()}
    print({k: (f, out[k]) for k, f in true.items() if out[k] != f}, model.threshold, model.slope, model.offset)
    assert sum(out[k] == f for k, f in true.items()) >= 0.95 * len(true)
    assert all(out[1000 + k] == licenses.UNKNOWN for k in range(20))


def test_rows_are_told_apart_by_their_texts(spark):
    rows = [(None, "prose first\nReleased under the MIT License."), (1, "Released under the MIT License."), (1, "plain prose"), (1, "Released under the MIT License."), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = licenses.scan(docs, licenses.train(docs)).collect()
    assert sorted((str(r.doc_id), str(r.license), r.n_candidates) for r in out) == [("1", "MIT", 1), ("1", "MIT", 1), ("1", "None", 0), ("None", "MIT", 1), ("None", "None", 0)]


def test_real_heads_and_look_alikes(spark, model):
    """Lines as real files have them, and ones that only look so."""
    texts = [
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "Apache-2.0"),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies", "GPL-3.0"),
        ("\t\t    GNU GENERAL PUBLIC LICENSE\n\t\t       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.", "GPL-2.0"),
        ("                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "LGPL"), ("                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n", "AGPL-3.0"),
        ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "MPL-2.0"), ("The MIT License (MIT)\n\nCopyright (c) 2015 Some Author\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal", "MIT"),
        ("BSD 3-Clause License\n\nCopyright (c) 2020, Some Author\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", "BSD"),
        ("// Licensed under the MIT License. See LICENSE in the project root for license information.", "MIT"), ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"),
        ("Not released under the MIT License.", "unknown"), ("Licensed under the Educational Community License, Version 2.0", "unknown"), ("This tool is no longer licensed under the Apache License, Version 2.0.", "unknown"), ("He works under a license of version 2.0 of the harbour rules.", "unknown"),
        ("A copyright notice hung above the public domain of the square.", "unknown"), ("Her driving licence was released by the council, not the court.", "unknown"), ("The general public license debate went on in the council.", "unknown"), ("They asked permission, free of charge, to use the old mill.", "unknown"),
    ]
    out = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string"), model).collect()}
    wrong = {texts[k][0][:60]: v for k, v in out.items() if v != texts[k][1]}
    print("WRONG", wrong)
    assert len(wrong) <= 1
