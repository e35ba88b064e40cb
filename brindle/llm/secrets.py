"""Secret scans. DataFrame functions only, one pass, no shuffle.

Three patterns give the base spans. Beside them, candidate strings (runs of
key-like characters with letters and digits) are read by a sliding window
whose character counts change by one character in and one out; its Shannon
entropy follows from the two counts that change. A candidate whose best
window passes the bound of its character class (hex, letters and digits,
base64) is a span of kind entropy, unless an allow-list pattern matches it or
a base span overlaps it.

Null text counts as empty: no spans. Offsets are code points, end exclusive.
Rows are independent, so repeated rows, ties and an empty table need nothing
special; columns beyond those named are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import running

KINDS = ("assign", "access", "hex", "entropy")

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: (class pattern, bits of a window's entropy that a secret reaches); the first class that matches counts.
CLASSES = ((r"^[0-9a-fA-F]+$", 2.9), (r"^[A-Za-z0-9]+$", 3.4), (r"^[A-Za-z0-9+/_=-]+$", 3.6))
#: Strings that look random and are no secrets: identifiers, samples, runs of one character, words joined by marks.
ALLOW = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|example|sample|placeholder|changeme|x{6,}|(.)\1{5,}|^[0-9+/_=-]+$|^[A-Za-z+/_=-]+$|^[a-z]+([-_/][a-z0-9]{1,10})+$"

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _found(text: Column, pattern: str) -> Column:
    """start, end and string of every match: what split() leaves between the matches gives their places."""
    m, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    pairs = F.arrays_zip(m.alias("m"), F.slice(gaps, F.lit(1), F.size(m)).alias("g"))
    length = lambda x: F.length(x["g"]) + F.length(x["m"])
    made = lambda at, x: F.struct((at + F.length(x["g"])).alias("start"), (at + length(x)).alias("end"), x["m"].alias("s"))
    kind = "struct<start:int,end:int,s:string>"
    return F.when(text.rlike(pattern), running(pairs, F.lit(0), lambda at, x: at + length(x), made, kind)).otherwise(F.array().cast(f"array<{kind}>"))


#: A character's count in a window needs five bits; twelve counts fill a long.
BITS, SLOTS = 5, 12


def _best_entropy(s: Column) -> Column:
    """The largest entropy, in bits, of the windows over s."""
    longs = -(-len(ALPHABET) // SLOTS)
    part = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    chars = F.split(s, "")
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1

    def count(acc: Column, k: Column) -> Column:
        own = acc["c0"]
        for j in range(1, longs):
            own = F.when(k >= j * SLOTS, acc[f"c{j}"]).otherwise(own)
        return F.call_function("shiftright", own, (BITS * (k % SLOTS)).cast("int")).bitwiseAND((1 << BITS) - 1).cast("int")

    def add(acc: Column, k: Column, by: int) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (BITS * (k % SLOTS)).cast("int")) * by
        fields = [F.when((k >= j * SLOTS) & (k < (j + 1) * SLOTS), acc[f"c{j}"] + one).otherwise(acc[f"c{j}"]).alias(f"c{j}") for j in range(longs)]
        return F.struct(*fields, (acc["total"] + (part(count(acc, k) + by) - part(count(acc, k)))).alias("total"), acc["least"].alias("least"))

    def move(acc: Column, i: Column, own: Column) -> Column:
        let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
        new, old = place(F.get(own, i)), place(F.get(own, i - WINDOW))
        gone = F.when(i >= WINDOW, let(old, lambda k: add(acc, k, -1))).otherwise(acc)
        full = lambda x: F.when(i >= WINDOW - 1, F.least(x["least"], x["total"])).otherwise(x["least"])
        return let(let(gone, lambda x: let(new, lambda k: add(x, k, 1))), lambda x: F.struct(*[x[f"c{j}"].alias(f"c{j}") for j in range(longs)], x["total"].alias("total"), full(x).alias("least")))

    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{j}") for j in range(longs)], F.lit(0.0).alias("total"), F.lit(1e9).alias("least"))
    # entropy = log2(window) - sum of c log2 c / window
    best = lambda own: F.aggregate(F.sequence(F.lit(0), F.size(own) - 1), zero, lambda acc, i: move(acc, i, own), lambda acc: F.log2(F.lit(float(WINDOW))) - acc["least"] / WINDOW)
    return F.get(F.transform(F.array(F.slice(chars, F.lit(1), F.length(s))), best), F.lit(0))


def scan(docs: DataFrame, keep: list[str], allow: str = ALLOW) -> DataFrame:
    """The columns named in keep, _base, the base spans, and spans, all: start, kind (a place in KINDS) and end of each secret, in order.

    Names in keep may be any but _base and spans.
    """
    df = docs.select(F.struct(*keep).alias("_keep"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    t = F.col("_t")
    df = df.select(
        "_keep", "_t", _found(t, ASSIGN).alias("_a"), _found(t, ACCESS).alias("_k"), _found(t, HEX).alias("_h"), _found(t, CANDIDATE).alias("_c"),
    )
    span = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))
    long_value = lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= 6
    base = F.array_sort(F.concat(F.transform(F.filter("_a", long_value), span(0)), F.transform("_k", span(1)), F.transform("_h", span(2))))
    df = df.select("_keep", base.cast(_SPAN).alias("_base"), "_c")

    def secret(x: Column) -> Column:
        s = x["s"]
        verdict = F.lit(False)
        for pattern, bits in reversed(CLASSES):
            verdict = F.when(s.rlike(pattern), _best_entropy(s) >= bits).otherwise(verdict)
        clear = ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        return s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~s.rlike(allow) & clear & verdict

    more = F.transform(F.filter("_c", secret), span(3))
    return df.select("_keep.*", "_base", F.array_sort(F.concat("_base", more)).cast(_SPAN).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span, or union of overlapping ones, replaced by mark. spans come in order."""
    clear = lambda at, x: F.when(x["start"] >= at, F.concat(F.substring(text, at + 1, x["start"] - at), F.lit(mark))).otherwise(F.lit(""))
    front = F.array_join(running(spans, F.lit(0), lambda at, x: F.greatest(at, x["end"]), clear, "string"), "")
    last = F.array_max(F.transform(spans, lambda x: x["end"]))
    return F.when(F.size(spans) > 0, F.concat(front, F.substring(text, last + 1, F.length(text)))).otherwise(text)
