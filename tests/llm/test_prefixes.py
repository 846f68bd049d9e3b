import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from orrery.llm import prefixes, queries

SF = "/root/testdata/sf0.001"


def plainly(rows):
    """The contract, restated: (conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(int)
    for s in members:
        if s:
            children[s[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    sha = lambda s: hashlib.sha256(",".join(map(str, ends[s])).encode()).hexdigest()
    return sorted((m[0], len(s), members[s[:-1]][0] if s else -1, len(m), children[s], leaves[s], saved[s], sha(s)) for s, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def made(seed, n=260, words=3, turns=9):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        k = r.choice([0, 0, 1, 2]) if c % 10 else r.randint(0, turns)
        rows += [(c, r.choice([j, j, j, None]), r.choice(["user", None, "bot"]), r.choice(["é" * w for w in range(words)] + [None])) for j in range(k)] or [(c, 0, "user", "x")]
    return rows * 1


KINDS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk", [1, 200, 4 << 20])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_tries(spark, monkeypatch, chunk, seed):
    """Chunks of a few sequences over several levels give what one chunk gives."""
    monkeypatch.setattr(prefixes, "CHUNK", chunk)
    monkeypatch.setattr(prefixes, "LAST", 20 if chunk < 1000 else prefixes.LAST)
    rows = made(seed)
    assert found(prefixes.trie(spark.createDataFrame(rows, KINDS))) == plainly(rows)


def test_copies_and_long_conversations(spark, monkeypatch):
    """A third of all conversations are copies, blocks of their ids are hashed in order; some conversations are long, one is a beginning of another."""
    monkeypatch.setattr(prefixes, "BLOCK", 64)
    monkeypatch.setattr(prefixes, "CHUNK", 3000)
    monkeypatch.setattr(prefixes, "LAST", 10)
    rows = [(c, k, "user", t) for c in range(3, 600, 3) for k, t in enumerate("abcdefgh")]
    rows += [(c, k, "user", f"{k}" if k < 500 + c else "z") for c in (1, 2, 4) for k in range(600)] + [(5, k, "user", f"{k}") for k in range(300)]
    rows += [(-250, 0, "a", "b"), (-200, 0, "user", "a"), (-200, 1, "user", "b"), (10**15, 0, None, None)]
    assert found(prefixes.trie(spark.createDataFrame(rows, KINDS))) == plainly(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "no conversation"), (7, None, None, None), (7, None, "", ""), (7, 1, "user", "x" * 300_000), (7, 1, "user", "x" * 300_000), (8, 2, "user", ""), (0, 0, "user", "a")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], KINDS + ", name string, n_convs long")
    assert found(prefixes.trie(df)) == plainly(rows)
    assert prefixes.trie(spark.createDataFrame([], KINDS)).count() == 0


def test_query_against_sql_and_plain_tries(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op12_prefixes(spark, SF)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found(out) == plainly(rows)
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    rel = c.sql(queries.oracle_sql()["op12_prefixes"])
    assert sorted(rel.columns) == sorted(out.columns)
    assert sorted(tuple(-1 if v is None else v for v in r) for r in rel.fetchall()) == plainly(rows)
