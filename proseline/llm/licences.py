"""License scans: Dice coefficient over word bigrams against licence templates, in DataFrame and SQL functions only.

Templates are whole licence texts and standard notices (``licence_texts``: a file for each text, and NOTICES with one notice a line; any
other list is a parameter). Words are lowered runs of letters and digits, so line breaks and punctuation don't matter. Of a template with
M bigrams, m of them distinct, windows of M bigrams of the text are compared: Dice is 2 |A and B| / (|A| + |B|) over the sets of
distinct bigrams, and ``threshold`` or more is a hit. So a licence is found as a whole text, inside a longer one and inside a long line.

Which templates are compared is pruned by size: with t the threshold, a window of a hit has between m t / (2 - t) and m (2 - t) / t
distinct bigrams, and at least m t / (2 - t) of the template's. A text without the needed number of a template's bigrams is not
compared with it, and a text that has none of the templates' anchors (of each template the longest bigrams, one more than a hit may
miss) is compared with none. Neither loses a hit. Which windows are compared: a template is cut in ``PROBES`` stretches, the longest
bigram of each is looked up in the text, and each of its places says where the template would begin; each of these places is one
window. An edited text whose probes are all changed is not found.
Of two whole texts, one after the other, both are found, for all 650 ordered pairs of the texts here but one (GFDL-1.3 before GFDL-1.2).

Texts of one family share most of their words, so windows of several templates hit one place. Hits are taken best first: that whose template's
distinct bigrams in common most outnumber its missing ones, then that with the higher coefficient, then the earlier one. A hit that shares
more than half of its bigrams, or of the other's, with one that was taken is dropped, unless both tie in both numbers and are of different licences; what is
dropped drops nothing itself.

The scan is narrow: one pass, no shuffle, no join, no Python. Bigrams are 64-bit hashes of two words (two of them
collide with a probability of about 2^-64); the templates are a literal of fixed size.

Defined results: null, empty and wordless texts and texts of one word have no hits. A licence is reported once for a text, with its
best window. Repeated rows are scanned each. Extra columns stay, but for one named licence_hits, which the result replaces.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.functions.text import let

from .common import table

THRESHOLD, PROBES = 0.8, 16
SEPARATOR = r"[^\p{L}\p{N}]+"
FOLDER = Path(__file__).parent / "licence_texts"
_BITS = 20


def standard_templates() -> list[tuple[str, str]]:
    """(licence, text) of the files, whose names begin with the licence's, and of the notices."""
    texts = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(FOLDER.glob("*.txt"))]
    return texts + [tuple(line.split("\t")) for line in (FOLDER / "NOTICES").read_text(encoding="utf-8").splitlines() if line]


def bigrams(text: str) -> list[tuple[str, str]]:
    words = re.findall(r"[^\W_]+", text.lower())
    return list(zip(words, words[1:], strict=False))


def hashed(pair: tuple[str, str]) -> int:
    """The xxhash64 of two strings, as the SQL function gives it."""
    import xxhash

    h = xxhash.xxh64_intdigest(pair[1].encode(), seed=xxhash.xxh64_intdigest(pair[0].encode(), seed=42))
    return h - (1 << 64) if h >> 63 else h


class Templates:
    """Templates in the form that is compared: literals of the plan."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.least = threshold / (2 - threshold)
        rows, anchors = [], set()
        for name, text in templates:
            pairs = bigrams(text)
            if not pairs:
                continue
            code = {p: hashed(p) for p in pairs}
            longest = lambda p: -len(p[0]) - len(p[1])
            distinct = sorted(code, key=lambda p: (longest(p), p))
            anchors.update(code[p] for p in distinct[: int(len(code) * (1 - self.least)) + 1])
            best: dict[int, tuple] = {}
            for at, p in enumerate(pairs):
                stretch = at * PROBES // len(pairs)
                best[stretch] = min(best.get(stretch, (1, 0, 0)), (longest(p), at, code[p]))
            rows.append((name, len(pairs), sorted(set(code.values())), [(h, at) for _, at, h in best.values()]))
        self.rows, self.anchors = rows, anchors
        self.vocabulary = {h for r in rows for h in r[2]}

    @staticmethod
    def numbers(values) -> Column:
        """An array literal of whole numbers, put together by the optimiser."""
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    @classmethod
    def bitmap(cls, hashes: set[int]) -> Column:
        words = [0] * (1 << (_BITS - 6))
        for h in hashes:
            for spot in (h & ((1 << _BITS) - 1), h >> _BITS & ((1 << _BITS) - 1)):
                words[spot >> 6] |= 1 << (spot & 63)
        return cls.numbers(w - (1 << 64) if w >> 63 else w for w in words)

    def literal(self) -> Column:
        return F.array(*[
            F.struct(F.lit(name).alias("licence"), F.lit(n).alias("n"), F.lit(len(b)).alias("m"), self.numbers(b).alias("b"), self.numbers(h for h, _ in probes).alias("probes"), self.numbers(at for _, at in probes).alias("at"))
            for name, n, b, probes in self.rows
        ])


def _is_set(bitmap: Column, h: Column) -> Column:
    """Whether both of the hash's two places in the bitmap are set: always for its members, seldom for others."""

    def at(x: Column) -> Column:
        spot = x.bitwiseAND(F.lit((1 << _BITS) - 1))
        return F.getbit(F.get(bitmap, F.shiftright(spot, 6).cast("int")), spot.bitwiseAND(F.lit(63)).cast("int")) == 1

    return at(h) & at(F.shiftright(h, _BITS))


_HIT = "struct<back:bigint,miss:double,start:bigint,stop:bigint,licence:string>"


def _windows(h: Column, t: Column, threshold: float) -> Column:
    """Hits of template t in the hashes h."""
    begin = lambda x, i: F.when(F.array_contains(t["probes"], x), F.greatest(F.lit(0), i - F.get(t["at"], (F.array_position(t["probes"], x) - 1).cast("int"))))
    begins = F.array_distinct(F.filter(F.transform(h, begin), lambda s: s.isNotNull()))

    def compare(s: Column) -> Column:
        window = F.slice(h, (s + 1).cast("int"), t["n"])
        sized = let(window, lambda w: F.struct(F.size(w).alias("n"), F.array_distinct(w).alias("a")))
        shared = lambda w: F.size(F.array_intersect(w["a"], t["b"])).cast("long")
        hit = lambda w, c: F.struct((t["m"] - c * 2).cast("long").alias("back"), (c * -2.0 / (F.size(w["a"]) + t["m"])).alias("miss"), s.cast("long").alias("start"), (s + w["n"]).cast("long").alias("stop"), t["licence"].alias("licence"))
        return let(sized, lambda w: let(shared(w), lambda c: hit(w, c)))

    return F.filter(F.transform(begins, compare), lambda x: x["miss"] <= -threshold)


def _resolve(hits: Column) -> Column:
    """One hit for each licence, in its order by name, of those that are left when the best are taken first."""

    def drops(y: Column, x: Column) -> Column:
        common = F.least(y["stop"], x["stop"]) - F.greatest(y["start"], x["start"])
        tie = (y["back"] == x["back"]) & (y["miss"] == x["miss"]) & (y["licence"] != x["licence"])
        return (common * 2 > F.least(y["stop"] - y["start"], x["stop"] - x["start"])) & ~tie

    left = F.aggregate(F.array_sort(hits), F.array().cast(f"array<{_HIT}>"), lambda kept, x: F.when(F.exists(kept, lambda y: drops(y, x)), kept).otherwise(F.concat(kept, F.array(x))))
    key = lambda x: F.struct((-x["miss"]).alias("dice"), (-x["back"]).alias("lead"), (-x["start"]).alias("back"), x["stop"].alias("stop"))

    def named(kept: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["licence"])))
        best = lambda n: F.array_max(F.transform(F.filter(kept, lambda x: x["licence"] == n), key))
        return F.transform(names, lambda n: let(best(n), lambda b: F.struct(n.alias("licence"), b["dice"].alias("dice"), (-b["back"]).cast("long").alias("start"), b["stop"].alias("stop"))))

    return let(left, named)


def scan_licences(docs: DataFrame, *, text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``licence_hits``: array of (licence, dice, start, stop), one for each licence found, in its order by name. start and
    stop are those of the window in the text's bigrams: the word at start is the first, the word at stop the last."""
    known = Templates(templates if templates is not None else standard_templates(), threshold)
    none = F.array().cast("array<struct<licence:string,dice:double,start:bigint,stop:bigint>>")
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "licence_hits"])
    if not known.rows:
        return rest.withColumn("licence_hits", none)
    words = F.filter(F.split(F.lower(F.col(text_col)), SEPARATOR), lambda w: w != "")
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    anchor, vocabulary, every = known.bitmap(known.anchors), known.bitmap(known.vocabulary), known.literal()

    def compared(h: Column) -> Column:
        shared = F.array_distinct(F.filter(h, lambda x: _is_set(vocabulary, x)))
        candidates = let(shared, lambda d: F.filter(every, lambda t: (F.size(d) >= t["m"] * known.least) & (F.size(F.array_intersect(t["b"], d)) >= t["m"] * known.least)))
        return let(F.flatten(F.transform(candidates, lambda t: _windows(h, t, threshold))), _resolve)

    found = let(let(words, pairs), lambda h: F.when(F.exists(h, lambda x: _is_set(anchor, x)), compared(h)).otherwise(none))
    return rest.withColumn("licence_hits", F.coalesce(found, none))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hits = F.col("licence_hits")
    return found.select(
        "doc_id",
        F.size(hits).cast("long").alias("n_licences"),
        F.array_join(F.transform(hits, lambda h: h["licence"]), ",").alias("licences"),
        F.round(F.coalesce(F.array_max(F.transform(hits, lambda h: h["dice"])), F.lit(0.0)), 6).alias("best_dice"),
    )
