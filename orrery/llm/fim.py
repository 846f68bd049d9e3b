"""Fill-in-middle transformation over a wavelet matrix of character classes.

Every code point has a class: what kind of character it is, and what kind comes before it. A unit (code point, word or
line) starts where the class is one of a set, so the number of units before any place is a sum of ranks of these
classes. The wavelet matrix of a slice of texts, laid end to end, answers ranks for all of its texts at once; a cut after
k units lies where the next unit starts, which select gives where one class starts units, and bisection on the ranks
where several do. Texts are cut whole, whatever their length; a slice holds about ``SLICE`` bytes, or one longer text.

The output orders the parts prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each after its mark; ``restored``
takes the text back from output and form alone: a text that holds a mark stays plain, so marks in an output are its own.

Defined cases: null text counts as empty, and empty texts stay plain; a null id draws like an empty one (``1:``);
repeated rows give equal rows; further columns pass through (new ones replace columns with the same name); an empty
table gives an empty one.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm.batches import sizes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, so many are cut; and of 100 cut ones, so many have the suffix first.
CUT, SUFFIX_FIRST = 90, 20
SLICE = 1 << 20
#: Kinds of characters. A class is four times the kind before (nothing counts as OPEN) plus a character's own kind.
OPEN, NEWLINE, SPACE, WORD, MARK, BITS = 0, 0, 1, 2, 3, 4
#: The classes that start a unit. A text's first code point always starts one.
UNITS = {
    "char": range(16),
    "word": [4 * before + own for before in (NEWLINE, SPACE) for own in (WORD, MARK)],
    "line": [4 * NEWLINE + own for own in range(4)],
}


@lru_cache(1)
def kinds():
    """The kind of each code point."""
    import numpy as np

    out = np.full(0x110000, MARK, np.uint8)
    for c in range(0x110000):
        letter = chr(c)
        if letter.isalnum():
            out[c] = WORD
        elif letter.isspace():
            out[c] = SPACE
    out[10] = NEWLINE
    return out


class Bits:
    """A bit vector with rank in constant time: packed words and the ones before each."""

    def __init__(self, bits):
        import numpy as np

        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i):
        """Ones among the first i bits, for an array of i."""
        import numpy as np

        low = np.left_shift(np.uint64(1), (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def place(self, k, bit: int):
        """Where the k-th (from 0) one, or zero, stands, for an array of k."""
        import numpy as np

        counts = self.before if bit else np.arange(len(self.before)) * 64 - self.before
        word = np.searchsorted(counts, k, side="right") - 1
        rest, at = k - counts[word], np.zeros(len(k), np.int64)
        held = self.words[word] if bit else ~self.words[word]
        for width in (32, 16, 8, 4, 2, 1):  # halves of the word, as far as the ones in their lower part go
            low = np.bitwise_count((held >> at.astype(np.uint64)) & np.uint64((1 << width) - 1))
            over = rest >= low
            rest, at = rest - np.where(over, low, 0), at + np.where(over, width, 0)
        return word * 64 + at


class WaveletMatrix:
    """Ranks and places of small symbols. Level by level symbols are parted by a bit, zeros first, in stable order."""

    def __init__(self, symbols, bits: int = BITS):
        import numpy as np

        self.levels, starts = [], {0: 0}
        for b in reversed(range(bits)):
            one = (symbols >> b) & 1
            level = Bits(one)
            self.levels.append((b, level, zeros := int(len(one) - one.sum())))
            nodes = {}
            for prefix, at in starts.items():  # where each group of symbols with equal upper bits begins
                ones = int(level.ones(np.array([at]))[0])
                nodes[2 * prefix], nodes[2 * prefix + 1] = at - ones, zeros + ones
            starts = nodes
            symbols = np.concatenate([symbols[one == 0], symbols[one == 1]])
        self.starts = starts

    def ranks(self, wanted, i):
        """How many of the wanted symbols stand among the first i, for an array of i; symbols with equal upper bits share their steps."""
        wanted, reached = set(wanted), {0: i}
        for b, level, zeros in self.levels:
            below = {}
            for prefix, at in reached.items():
                one = level.ones(at)
                below[2 * prefix], below[2 * prefix + 1] = at - one, zeros + one
            reached = {p: at for p, at in below.items() if any(w >> b == p for w in wanted)}
        return sum(at - self.starts[w] for w, at in reached.items())

    def places(self, symbol: int, k):
        """Where the k-th (from 0) of a symbol stands, for an array of k."""
        at = k + self.starts[symbol]
        for b, level, zeros in reversed(self.levels):
            at = level.place(at - zeros, 1) if symbol >> b & 1 else level.place(at, 0)
        return at


def _classes(texts: list[str]):
    """The classes of the texts' code points, laid end to end, and where each text starts."""
    import numpy as np

    kind = kinds()
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    whole, step = "".join(texts), 1 << 20
    own = np.concatenate([np.zeros(0, np.uint8), *(kind[np.frombuffer(whole[k : k + step].encode("utf-32-le", "surrogatepass"), "<u4")] for k in range(0, len(whole), step))])
    before = np.concatenate([[OPEN], own[:-1]]).astype(np.uint8)[: len(own)]
    before[starts[:-1][np.diff(starts) > 0]] = OPEN
    return 4 * before + own, starts


def cut_places(texts: list[str], draws, unit: str = "char"):
    """(units, first cut, second cut) of each text: after draws[j] modulo units + 1 units, the smaller first; cuts in code points."""
    import numpy as np

    symbols, starts = _classes(texts)
    wanted = UNITS[unit]
    begin, end = starts[:-1], starts[1:]
    if not len(symbols):
        none = np.zeros(len(texts), np.int64)
        return none, none, none
    matrix = WaveletMatrix(symbols)
    # a text's first code point starts a unit whether its class does or not
    first = np.where(begin < end, 1 - np.isin(symbols[np.minimum(begin, len(symbols) - 1)], list(wanted)), 0)
    base = matrix.ranks(wanted, begin)
    units = matrix.ranks(wanted, end) - base + first
    cuts = []
    for k in np.sort(np.stack([d % (units + 1).astype(np.uint64) for d in draws]).astype(np.int64), axis=0):
        if len(wanted) == 1:
            inside = (k < units) & (k >= first) & (units > 0)
            at = np.where(k < first, begin, end)
            at[inside] = matrix.places(list(wanted)[0], (base + k - first)[inside])
        else:
            at, high = begin.copy(), end.copy()
            while (open_ := at < high).any():  # the least place with more than k units before its end
                middle = (at + high) >> 1
                more = matrix.ranks(wanted, middle + 1) - base + first > k
                high = np.where(open_ & more, middle, high)
                at = np.where(open_ & ~more, middle + 1, at)
        cuts.append(at - begin)
    return units, *cuts


KIND = "units long, first long, second long"


def _cut(text: pa.Array, *draws: pa.Array, unit: str = "char") -> pa.Array:
    import numpy as np

    out, start, held = [np.zeros((3, 0), np.int64)], 0, 0
    size = [*sizes(text), None]
    for k, n in enumerate(size):
        if n is None or (k > start and held + n > SLICE):
            values = [t or "" for t in text.slice(start, k - start).to_pylist()]
            out.append(np.stack(cut_places(values, [d.slice(start, k - start).to_numpy(zero_copy_only=False).astype(np.uint64) for d in draws], unit)))
            start, held = k, 0
        held += n or 0
    return pa.StructArray.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], ["units", "first", "second"])


def draw(key: Column, group: int) -> Column:
    """The group-th (from 0) eight hexadecimal digits, as a number, of the SHA-256 of the key behind ``1:``."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "char", cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """df with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``."""

    def run(t: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return _cut(t, a, b, unit=unit)

    whole = F.coalesce(F.col(text), F.lit(""))
    cuts = F.arrow_udf(run, KIND)(F.col(text), draw(F.col(key), 0), draw(F.col(key), 1))
    rows = df.withColumn("fim cuts", cuts)
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | whole.contains(m)
    plain = (whole == "") | marked | (draw(F.col(key), 2) % 100 >= cut)
    form = F.when(plain, "plain").when(draw(F.col(key), 3) % 100 < suffix_first, "spm").otherwise("psm")
    a, b = F.col("fim cuts")["first"].cast("int"), F.col("fim cuts")["second"].cast("int")
    parts = F.substring(whole, F.lit(1), a), F.substring(whole, a + 1, b - a), F.substring(whole, b + 1, F.length(whole))
    rows = rows.withColumn("form", form).withColumn("n", F.col("fim cuts")["units"])
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    psm = F.concat(F.lit(PREFIX), parts[0], F.lit(SUFFIX), parts[2], F.lit(MIDDLE), parts[1])
    spm = F.concat(F.lit(SUFFIX), parts[2], F.lit(PREFIX), parts[0], F.lit(MIDDLE), parts[1])
    rows = rows.withColumn("prefix_chars", cut_only(a.cast("long"))).withColumn("middle_chars", cut_only((b - a).cast("long")))
    return rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(whole)).drop("fim cuts")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
