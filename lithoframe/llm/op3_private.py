"""PII: base patterns seed lexical context patterns, Spark scores the pattern-instance graph, good patterns find unseen identifiers.

Base spans (email, ip, card, phone) are the seeds. Every seed and every other identifier-like token gives four lexical
patterns: its two words to the left; one word on either side; the word to the left with the punctuation between; and the
word to the left with the identifier's shape (its digits, and whether it has letters). Words are whole, however long. In
each round a pattern's confidence for a kind is the
summed confidence of its distinct instances over their number plus one, and an unseen instance takes the best confidence
of its patterns that have MIN_SEEDS instances of the kind. Instances of MIN_CONFIDENCE after ROUNDS rounds are reported as
`context-<kind>` spans, after the base spans.

Candidates are small rows beside the texts; joins are on 64-bit hashes of patterns and instances, and every side that is
joined to the edges has one row for each key and kind. Texts are read once.

Defined cases: a null or empty text has no span; ties are ordered by kind, start and end; rows with equal or null doc_id
are answered one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, frugal, small_batches, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE = 3, 3, 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OTHER = re.compile(r"(?<![0-9A-Za-z_-])[A-Z]{0,4}-?[0-9][0-9A-Za-z-]{4,}")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"\w+|[^\w\s]")


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's leftmost non-overlapping matches, found from each @ outwards so that long runs cost no more."""
    done = 0
    at = text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at)):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in order of start."""
    ip = [m.span() for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
    card = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            card.append(m.span())
    phone = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return [list(emails(text)), ip, card, phone]


def patterns(text: str, found: list[tuple[int, int, int]]) -> Iterator[list[str]]:
    """The lexical patterns of each of found(start, end, kind), from the text's words and signs."""
    spans = [m.span() for m in _TOKEN.finditer(text)] if found else []
    starts, ends = [s for s, _ in spans], [e for _, e in spans]
    is_word = [text[s].isalnum() or text[s] == "_" for s in starts]
    for s, e, _ in found:
        k = bisect_right(ends, s) - 1
        signs, words = [], []
        while k >= 0 and len(words) < 2:
            token = text[spans[k][0] : spans[k][1]].lower()
            if is_word[k]:
                words.append(token)
            elif not words and len(signs) < 3:
                signs.append(token)
            k -= 1
        one, two = [*words, "^", "^"][:2]
        k = bisect_left(starts, e)
        while k < len(spans) and not is_word[k]:
            k += 1
        after = text[spans[k][0] : spans[k][1]].lower() if k < len(spans) else "$"
        own = text[s:e]
        shape = f"{sum(map(str.isdigit, own))}{'a' * any(map(str.isalpha, own))}"
        yield [f"{two} {one} _", f"{one} _ {after}", f"{one} {''.join(signs[::-1])}_", f"{one} _{shape}"]


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


def occurrences(text: str, spans: list[list[tuple[int, int]]]) -> list[dict]:
    """Base spans and identifier-like tokens outside them, each with its instance and patterns; a base kind or -1."""
    found = [(s, e, k) for k, own in enumerate(spans) for s, e in own]
    taken = sorted((s, e) for s, e, _ in found)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    for m in _OTHER.finditer(text):
        s, e = m.span()
        i = int(np.searchsorted(starts, e)) - 1
        if i < 0 or reach[i] <= s:
            found.append((s, e, -1))
    return [{"kind": k, "instance": _hash(text[s:e]), "patterns": [_hash(f"{n}{p}") for n, p in enumerate(own)], "s": s, "e": e} for (s, e, k), own in zip(found, patterns(text, found), strict=True)]


_OCC = pa.list_(pa.struct([("kind", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64())), ("s", pa.int64()), ("e", pa.int64())]))
_ROW = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()), ("occ", _OCC)])
_ROW_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, occ array<struct<kind: int, instance: long, patterns: array<long>, s: long, e: long>>"


@frugal
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            spans = base_spans(text)
            base = ",".join(f"{k}:{s}:{e}" for k, own in zip(KINDS, spans, strict=True) for s, e in own)
            rows.append({"doc_id": doc_id, **{f"n_{k}": len(own) for k, own in zip(KINDS, spans, strict=True)}, "base": base, "occ": occurrences(text, spans)})
        yield pa.RecordBatch.from_pylist(rows, schema=_ROW)


def learn(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, conf) of unseen instances, from distinct edges (pattern, instance, kind or -1)."""
    seeds = edges.where("kind >= 0").select("pattern", "instance", "kind", F.lit(1.0).alias("conf"))
    size = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("size"))
    unseen = edges.where("kind < 0").select("pattern", "instance")
    scored = seeds
    for _ in range(rounds):
        patterns = scored.groupBy("pattern", "kind").agg(F.sum("conf").alias("sum"), F.count_if(F.col("conf") > 0.5).alias("n")).join(size, "pattern")
        patterns = patterns.where(F.col("n") >= MIN_SEEDS).select("pattern", "kind", (F.col("sum") / (F.col("size") + 1)).alias("p"))
        best = unseen.join(patterns, "pattern").groupBy("instance", "kind").agg(F.max("p").alias("conf"))
        best = cut(best, "private-round")
        scored = seeds.unionByName(unseen.join(best, "instance").select("pattern", "instance", "kind", "conf"))
    return best


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: counts, base spans, all spans."""
    small_batches(docs)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(_scan, _ROW_DDL)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "private-rows")
    each = rows.where(F.size("occ") > 0).select("row", F.explode("occ").alias("o")).select("row", "o.*")
    edges = cut(each.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct(), "private-edges")
    good = learn(edges).where(F.col("conf") >= MIN_CONFIDENCE).groupBy("instance").agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("as"))
    names = F.array(*[F.lit(f"context-{k}") for k in KINDS])
    more = each.where("kind < 0").join(good, "instance").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("as", "s", "e"))).alias("found"))
    text = F.concat_ws(",", F.transform("found", lambda x: F.concat_ws(":", F.element_at(names, x["as"] + 1), x["s"].cast("string"), x["e"].cast("string"))))
    more = more.select("row", text.alias("context"), F.size("found").cast("long").alias("n_context"))
    joined = rows.drop("occ").join(more, "row", "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("context") != "", F.col("context")))
    return joined.select("doc_id", *[f"n_{k}" for k in KINDS], F.coalesce("n_context", F.lit(0).cast("long")).alias("n_context"), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))
