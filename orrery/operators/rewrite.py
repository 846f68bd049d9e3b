"""Whether a question needs its history to be understood, and what of a model's rewrite may be used."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from orrery.functions.text import strip

#: Words that point back, follow-ups without a topic, and what a model wraps its rewrite in.
POINTS_BACK = "这个|那个|这些|那些|这种|那种|这里|那里|它|上述|前面提到|刚才|之前说"
FOLLOW_UP = "怎么办|咋办|怎么弄|怎么搞|然后呢|还有呢|接着呢|呢[？?]?$|^那"
FENCE = r"^\s*```[A-Za-z]*\s*|\s*```\s*$"
PREFIX = r"^\s*(改写后的问题|改写后|改写结果|改写|输出|结果|Rewritten query|Rewritten)\s*[:：]\s*"
TALK = r"^\s*(说明|解释|理由|分析|注意|首先|其次|然后|因此|所以|思考|推导|思路)[:：]"
QUOTES = "\"'“”‘’「」『』"
ASKING = ("吗", "呢", "怎么", "什么", "多少", "如何", "哪", "为什么", "是否", "几")
LONGEST = 200


def needs_rewrite(query: Column, n_history: Column) -> Column:
    text = strip(F.coalesce(query, F.lit("")))
    return (text != "") & (F.coalesce(n_history, F.lit(0)) > 0) & (text.rlike(POINTS_BACK) | text.rlike(FOLLOW_UP))


def is_question(text: Column) -> Column:
    return text.rlike("[？?]$") | text.rlike("|".join(ASKING))


def sanitized(raw: Column, original: Column, longest: int = LONGEST) -> Column:
    """The first usable line of a model's answer, bare; null if there is none, or if it is too long. A question stays one."""

    def bare(line: Column) -> Column:
        inner = strip(F.regexp_replace(line, PREFIX, ""))
        return F.regexp_replace(strip(F.regexp_replace(inner, f"^[{QUOTES}]+|[{QUOTES}]+$", "")), r"(?U)\s+", " ")

    lines = F.transform(F.split(raw, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda x: strip(F.regexp_replace(x, FENCE, "")))
    usable = F.transform(F.filter(lines, lambda x: (x != "") & ~x.rlike(TALK)), bare)
    first = F.get(F.filter(usable, lambda x: (x != "") & (~is_question(F.coalesce(original, F.lit(""))) | is_question(x))), 0)
    return F.when(F.length(first) <= longest, first)
