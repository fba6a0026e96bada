r"""Secret scans: fixed patterns, and a battery of randomness tests for everything else.

Fixed kinds, leftmost and non-overlapping each:
``assign``  a name such as password or api_key, then ``:`` or ``=``, then a value of 6 or more characters;
``access``  AKIA and upper-case letters or digits, 20 or more characters in all;
``hex``     24 or more of ``[0-9a-f]``.

The battery looks at every run of 20 or more of ``[A-Za-z0-9+/_=-]`` outside these. Its encoding
is inferred from the characters (base 16, 32 or 64). Three tests ask if it could be uniform noise in
that encoding: chi-squared over alphabet classes (upper, lower, digit, sign), a runs test on
upper and lower halves of the alphabet, and the serial correlation of neighbouring symbols. What
passes them gets a p-value for being ordinary writing: the likelihood of its letters as
language (one letter in 17 upper case, where both occur) over their likelihood as noise, which by Markov's inequality is below x with probability
x at most. Longer runs hold more tests in disguise (every start of a piece), so p-values are
multiplied by length over 20, and the Benjamini-Hochberg rule holds the share of false finds of a text to
``rate``. Everything is Column expressions on one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.words import let

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
#: Share of each letter in running European text, in percent (a to z).
LETTERS = [8.6, 1.5, 3.2, 3.8, 13.0, 1.8, 2.0, 4.6, 7.3, 0.4, 0.8, 4.3, 2.7, 7.4, 7.0, 2.2, 0.4, 6.6, 6.9, 8.3, 3.1, 1.1, 1.5, 0.3, 1.5, 0.3]
SPAN = "array<struct<start:int,rank:int,stop:int>>"


def spans(text: Column, pattern: str, rank: int, keep: Column | None = None, group_min: int = 0) -> Column:
    """Array of (start, rank, stop) of the matches of ``pattern``, in code points, end exclusive.

    What a text is split into and what lies between add up to the text, so the places are running
    sums of lengths. ``group_min`` drops matches whose first group is shorter.
    """

    def place(parts: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.when(x["fits"], F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + x["gap"] + x["size"]).alias("stop"))))).otherwise(acc["out"]).alias("out"))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step)["out"]

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if group_min else found
    gaps = F.split(text, pattern, -1)
    parts = let(found, lambda m: let(gaps, lambda g: let(value, lambda v: F.transform(m, lambda x, i: F.struct(F.length(F.get(g, i)).alias("gap"), F.length(x).alias("size"), (F.length(F.get(v, i)) >= group_min).alias("fits"))))))
    return F.when(F.regexp_like(text, F.lit(pattern)), place(parts)).otherwise(F.array().cast(SPAN))


def _battery(run: Column) -> Column:
    """p-value for being ordinary writing; 1 for what the tests don't take for noise."""
    n = F.length(run).cast("double")
    size = lambda pattern: n - F.length(F.regexp_replace(run, pattern, ""))

    def judge(c: Column) -> Column:
        lower, upper, digit, sign = c["lower"], c["upper"], c["digit"], c["sign"]
        is16 = (c["beyond16"] == 0) & ((lower == 0) | (upper == 0))
        is32 = (sign == 0) & ((lower == 0) | (upper == 0))
        share = lambda a, b, d: F.when(is16, F.lit(a)).when(is32, F.lit(b)).otherwise(F.lit(d))
        letters = F.when(is16 | is32, lower + upper)
        # Expected shares of letters (either case apart in base 64), digits and signs.
        chi = lambda seen, want: F.when(n * want > 0, (seen - n * want) * (seen - n * want) / (n * want)).otherwise(seen * 100)
        digits = share(10 / 16, 6 / 32, 10 / 64)
        chi2 = F.when(letters.isNotNull(), chi(letters, 1 - digits) + chi(digit, digits)).otherwise(chi(lower, F.lit(26 / 64)) + chi(upper, F.lit(26 / 64)) + chi(digit, digits) + chi(sign, F.lit(2 / 64)))
        # 99.9 % points for 1 and 3 degrees of freedom.
        uniform = chi2 <= F.when(letters.isNotNull(), 10.83).otherwise(16.27)
        noise = F.log(share(16.0, 32.0, 64.0))
        writing = F.aggregate(c["codes"], F.lit(0.0), lambda acc, x: acc + F.element_at(F.array(*[F.lit(v) for v in _LOGS]), x + 1))
        case = F.when(is16 | is32, F.lit(0.0)).otherwise(upper * math.log(0.06) + lower * math.log(0.94))
        likelihood = writing + case + n * noise
        return F.when(uniform & c["mixed"] & (F.abs(c["runs_z"]) <= 3.29) & (F.abs(c["serial_z"]) <= 3.29), F.least(F.lit(1.0), F.exp(F.least(likelihood, F.lit(0.0))) * n / 20)).otherwise(1.0)

    def counts(values: Column) -> Column:
        # Symbols in two halves by parity of their code, which fits any of the alphabets.
        half = F.transform(values, lambda v: v % 2)
        above = F.aggregate(half, F.lit(0.0), lambda a, x: a + x)
        changes = F.aggregate(F.transform(half, lambda x, i: F.when((i > 0) & (x != F.get(half, F.greatest(i - 1, F.lit(0)))), 1.0).otherwise(0.0)), F.lit(1.0), lambda a, x: a + x)
        mean = 2 * above * (n - above) / n + 1
        spread = F.sqrt(F.greatest(F.lit(0.25), (mean - 1) * (mean - 2) / (n - 1)))
        middle = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
        around = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - middle) * (x - middle))
        shifted = F.aggregate(F.transform(values, lambda x, i: F.when(i > 0, (x - middle) * (F.get(values, F.greatest(i - 1, F.lit(0))) - middle)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
        fields = {"lower": size("[a-z]+"), "upper": size("[A-Z]+"), "digit": size("[0-9]+"), "sign": size("[+/_=-]+"), "beyond16": n - size("[0-9A-Fa-f]+")}
        fields["runs_z"] = (changes - mean) / spread
        fields["serial_z"] = F.when(around > 0, shifted / around).otherwise(1.0) * F.sqrt(n)
        fields["mixed"] = (F.length(F.regexp_replace(run, "[^0-9]+", "")) > 0) & (F.length(F.regexp_replace(run, "[^A-Za-z]+", "")) > 0)
        # Letters by their place, everything else at 26.
        fields["codes"] = F.transform(values, lambda v: F.when((v >= 97) & (v <= 122), v - 97).when((v >= 65) & (v <= 90), v - 65).otherwise(F.lit(26)))
        return F.struct(*[x.alias(k) for k, x in fields.items()])

    codes = F.transform(F.split(run, "(?!^)"), lambda c: F.ascii(c))
    return let(codes, lambda v: let(counts(v), judge))


#: Log-likelihood of a letter in writing; of digits and signs 1 in 20 for each ten of them.
_LOGS = [math.log(x / 100) for x in LETTERS] + [math.log(0.005)]


def noise_spans(text: Column, taken: Column, rate: float = 0.01) -> Column:
    """Runs outside ``taken`` that the battery finds, at false-discovery rate ``rate`` in the text."""

    def pick(found: Column) -> Column:
        m = F.size(found)
        ranked = F.sort_array(F.transform(found, lambda x: F.struct(x["p"].alias("p"), x["s"].alias("s"))))
        last = let(ranked, lambda r: F.struct(r.alias("r"), F.array_max(F.transform(r, lambda x, i: F.when(x["p"] <= rate * (i + 1) / m, i).otherwise(F.lit(-1)))).alias("k")))
        return let(last, lambda z: F.transform(F.filter(z["r"], lambda x, i: i <= z["k"]), lambda x: x["s"]))

    def outside(all_: Column) -> Column:
        free = F.filter(all_, lambda s: ~F.exists(taken, lambda t: (t["start"] < s["stop"]) & (s["start"] < t["stop"])))
        return F.transform(free, lambda s: F.struct(_battery(F.substring(text, s["start"] + 1, s["stop"] - s["start"])).alias("p"), s.alias("s")))

    return F.when(F.regexp_like(text, F.lit(RUN)), let(outside(spans(text, RUN, 3)), pick)).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """``docs`` with columns base and added more: arrays of (start, rank, stop), rank in KINDS.

    Null and empty texts have no spans. Spans of different fixed kinds may overlap; added ones overlap
    no fixed one. Rows are scanned one by one, so repeated rows and extra columns pass unchanged (any
    column named base or added is replaced). An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    base = F.array_sort(F.concat(spans(text, ASSIGN, 0, group_min=6), spans(text, ACCESS, 1), spans(text, HEX, 2)))
    kept = [c for c in docs.columns if c.lower() not in ("base", "added")]
    found = let(base, lambda b: F.struct(b.alias("base"), noise_spans(text, b, rate).alias("added"))).alias("__kindred_found")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], found)
    return rows.select(*[F.col(f"`{c}`") for c in kept], "__kindred_found.base", "__kindred_found.added")


def listing(found: Column) -> Column:
    """kind:start:stop, by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mask``; overlapping spans give one."""
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["stop"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
    )
    done = F.aggregate(F.array_sort(found), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(found) == 0, text).otherwise(let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text)))))
