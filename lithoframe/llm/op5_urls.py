"""URL filters: a sorted array of 64-bit xxhash keys, memory-mapped, probed by binary search, hits confirmed on the full strings.

Entries are `host/path` strings. A rule entry fits its host and all subdomains when the url's path starts with the rule's
path; the longest fitting rule decides (by length of `host/path`; on a tie, the longer host). Entries of the block list
are judged in the same way where no rule fits: a listed host blocks itself and its subdomains, a listed path all that
starts with it. Everything else is allowed.

The index is one file: keys in order, verdicts, offsets, and the strings. The driver writes it once to the shared folder and
Spark brings it to every executor, whose workers map it and keep it mapped for later tasks. A url makes one key for each
pair of a host length and a path length that entries have, if its host has a label boundary there; so a url costs in
proportion to its length and to the entries' own lengths, however many labels it has. All keys of a batch go through one
vectorised binary search; a hit counts only if the stored string is equal, so colliding digests do no harm. Lists of more
than MAX_ENTRIES stay a table: filter_urls_table gives the same answers by a join on the same keys and strings.

Defined cases: null urls and urls without `://` have an empty host and path, no rule, and are allowed; repeated rows are
each answered; an entry that stands twice counts by its first place among rules, else by the lesser verdict; null entries
match nothing; a list may be empty, and so may pages; other columns are ignored.
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, shared_dir, small_batches, table

#: Rules of the contract, as text: verdict and host/path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words of which the registered query's block list is built: every two of them joined by a hyphen, under each domain.
LIST_WORDS = (
    "adult ads bet bets betting bonus cams casino cheap clicks coins crack dating deals dice escort farm fast free gamble hot jackpot keygen links "
    "live loans lotto malware meds money nude online pharma phish pills poker porn promo replica scam sex slots spam track viagra warez win wins x xxx"
)
LIST_DOMAINS = ("example.com", "example.net", "example.org")
MAX_ENTRIES = 2_000_000
VERDICTS = ("allow", "block")
SEED = 42  # that of Spark's xxhash64, so both ways have the same keys
PROBES_AT_ONCE = 100_000

_HEAD = struct.Struct("<8sQQ")


def listed_hosts() -> list[str]:
    words = LIST_WORDS.split()
    return [f"{a}-{b}.{d}/" for a in words for b in words if a != b for d in LIST_DOMAINS]


def split_entry(entry: bytes) -> tuple[bytes, bytes]:
    at = entry.find(b"/")
    return (entry, b"") if at < 0 else (entry[:at], entry[at:])


def pack_index(entries: Iterable[tuple[str, str]]) -> bytes:
    """The file of (verdict, entry): its head, keys in order, ends of strings, verdicts, the strings."""
    first: dict[str, str] = {}
    for verdict, text in entries:
        first.setdefault(text, verdict)
    if len(first) > MAX_ENTRIES:
        raise ValueError(f"{len(first)} entries; filter_urls_table takes more than {MAX_ENTRIES}")
    keyed = sorted((xxhash.xxh64_intdigest(t.encode(), SEED), t.encode(), VERDICTS.index(v)) for t, v in first.items())
    keys = np.array([k for k, _, _ in keyed], np.uint64)
    ends = np.cumsum([len(t) for _, t, _ in keyed], dtype=np.int64)
    blob = b"".join(t for _, t, _ in keyed)
    return b"".join([_HEAD.pack(b"LFURLIX1", len(keyed), len(blob)), keys.tobytes(), ends.tobytes(), bytes(v for _, _, v in keyed), blob])


class DigestArray:
    """An index over a buffer, which may be a mapped file."""

    def __init__(self, data: bytes | mmap.mmap) -> None:
        magic, n, size = _HEAD.unpack_from(data)
        if magic != b"LFURLIX1":
            raise ValueError("not an index of urls")
        at = _HEAD.size
        self.keys = np.frombuffer(data, np.uint64, n, at)
        self.ends = np.frombuffer(data, np.int64, n, at + 8 * n)
        self.values = np.frombuffer(data, np.uint8, n, at + 16 * n)
        self.blob = memoryview(data)[at + 17 * n : at + 17 * n + size]
        self.shapes = sorted({tuple(map(len, split_entry(self.text(k)))) for k in range(n)})

    def text(self, k: int) -> bytes:
        return bytes(self.blob[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])])

    def probe(self, texts: list[bytes]) -> np.ndarray:
        """The place of each text, or -1. Equal digests of different strings are told apart by the strings."""
        found = np.full(len(texts), -1)
        if not len(self.keys) or not texts:
            return found
        keys = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if self.text(k) == texts[i]:
                    found[i] = k
                    break
                k += 1
        return found


def candidates(host: bytes, path: bytes, shapes: list[tuple[int, int]]) -> list[bytes]:
    """Every entry that could fit a url, of the lengths that entries have."""
    return [host[len(host) - h :] + path[:p] for h, p in shapes if 0 < h <= len(host) and p <= len(path) and (h == len(host) or host[-h - 1 : len(host) - h] == b".")]


def best(array: DigestArray, urls: list[tuple[str, str]]) -> list[int]:
    """For each (host, path) the place of the entry that decides, or -1: the longest `host/path`, then the longest host."""
    out, rank = [-1] * len(urls), [(-1, -1)] * len(urls)
    keys: list[bytes] = []
    owner: list[int] = []

    def settle() -> None:
        hits = array.probe(keys)
        for j in np.flatnonzero(hits >= 0):
            text = keys[j].decode()
            own = (len(text), len(text.partition("/")[0]))
            if own > rank[owner[j]]:
                rank[owner[j]], out[owner[j]] = own, int(hits[j])
        keys.clear()
        owner.clear()

    for i, (host, path) in enumerate(urls):
        own = candidates(host.encode(), path.encode(), array.shapes)
        keys += own
        owner += [i] * len(own)
        if len(keys) >= PROBES_AT_ONCE:
            settle()
    settle()
    return out


_MAPPED: dict[str, DigestArray] = {}


def ship(spark: SparkSession, entries: Iterable[tuple[str, str]]) -> str:
    """Write the index to the shared folder, once for its content, and have it brought to the executors; its name there."""
    data = pack_index(entries)
    name = f"lithoframe-urls-{xxhash.xxh3_128_hexdigest(data)}.index"
    folder = f"{shared_dir(spark)}/lithoframe-indexes"
    uri = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    files, path = pyarrow.fs.FileSystem.from_uri(uri)
    if files.get_file_info(f"{path}/{name}").type == pyarrow.fs.FileType.NotFound:
        files.create_dir(path, recursive=True)
        with files.open_output_stream(f"{path}/{name}.part") as f:
            f.write(data)
        files.move(f"{path}/{name}.part", f"{path}/{name}")
    if not any(x.endswith(name) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(f"{uri}/{name}")
    return name


def mapped(name: str) -> DigestArray:
    """The index of this name, mapped once for each worker."""
    if name not in _MAPPED:
        with open(SparkFiles.get(name), "rb") as f:
            _MAPPED[name] = DigestArray(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    return _MAPPED[name]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as columns; both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "(?s)^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, listed: Sequence[str] | DataFrame = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page id, host, path, the rule that decided (or null) and the verdict of every row; listed is a sequence or a table with a column entry."""
    spark = pages.sparkSession
    if isinstance(listed, DataFrame):
        entries = listed.select(F.col("entry").cast("string")).where("entry is not null").distinct().limit(MAX_ENTRIES + 1)
        listed = [r.entry for r in entries.toLocalIterator()]
    by_rule, by_list = ship(spark, rules), ship(spark, (("block", x) for x in listed))

    @frugal
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_index, list_index = mapped(by_rule), mapped(by_list)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            urls = list(zip(hosts, paths, strict=True))
            ruled, banned = best(rule_index, urls), best(list_index, urls)
            rule = [rule_index.text(k).decode() if k >= 0 else None for k in ruled]
            verdict = [VERDICTS[rule_index.values[k]] if k >= 0 else "block" if b >= 0 else "allow" for k, b in zip(ruled, banned, strict=True)]
            yield pa.record_batch({"page_id": batch.column("page_id"), "host": batch.column("host"), "path": batch.column("path"), "rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())})

    small_batches(pages)
    host, path = host_path(pages[url_col])
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def _deciding(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, path, entry, value) of distinct urls(host, path) that some row of entries(entry, value) fits: the longest one."""
    host, path = F.substring_index("entry", "/", 1), F.length("entry") - F.length(F.substring_index("entry", "/", 1))
    entries = entries.where("entry is not null").groupBy("entry").agg(F.min("value").alias("value"))
    shapes = entries.select(F.length(host).alias("h"), path.alias("p")).where("h > 0").distinct()
    # one row for each pair of lengths, whatever the number of entries: as one array it meets every url
    shapes = shapes.agg(F.collect_list(F.struct("h", "p")).alias("shapes"))
    fits = lambda x: (x["h"] <= F.length("host")) & (x["p"] <= F.length("path")) & ((x["h"] == F.length("host")) | (F.substring("host", F.length("host") - x["h"], F.lit(1)) == "."))
    text = lambda x: F.concat(F.substring("host", F.length("host") - x["h"] + 1, x["h"]), F.substring("path", F.lit(1), x["p"]))
    probes = urls.join(F.broadcast(shapes)).select("host", "path", F.explode(F.transform(F.filter("shapes", fits), text)).alias("probe")).withColumn("key", F.xxhash64("probe"))
    hits = probes.join(entries.withColumn("key", F.xxhash64("entry")), "key").where("probe = entry")
    rank = F.struct(F.length("entry").alias("n"), F.length(F.substring_index("entry", "/", 1)).alias("h"))
    return hits.groupBy("host", "path").agg(F.max_by(F.struct("entry", "value"), rank).alias("hit")).select("host", "path", "hit.*")


def filter_urls_table(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """What filter_urls gives, for rules(verdict, entry) and listed(entry) of any size.

    Distinct urls meet the entries on 64-bit keys, and full strings decide. Urls that many rows share are judged once, and
    come back in a join of many rows against one row for each url, which can be split.
    """
    host, path = host_path(pages[url_col])
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = rows.where("host != ''").select("host", "path").distinct()
    ruled = _deciding(urls, rules.select("entry", F.col("verdict").alias("value"))).select("host", "path", F.col("entry").alias("rule"), "value")
    banned = _deciding(urls, listed.select("entry", F.lit("block").alias("value"))).select("host", "path", F.lit(True).alias("banned"))
    judged = urls.join(ruled, ["host", "path"], "left").join(banned, ["host", "path"], "left")
    done = rows.join(judged, ["host", "path"], "left")
    return done.select("page_id", "host", "path", "rule", F.coalesce("value", F.when(F.col("banned"), "block").otherwise("allow")).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES, listed_hosts())


_ENTRIES = "(VALUES ('block','net','/'),('allow','example.net','/en/'),('block','example.com','/de/'),('allow','org','/fr/')) r(verdict, rhost, rpath)"
_DOMAINS = "(VALUES ('example.com'),('example.net'),('example.org')) d(domain)"
OP5_SQL = f"""
WITH rest AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(coalesce(url,''),'://') > 0 THEN substr(url, strpos(url,'://')+3) ELSE '' END AS r FROM pages),
parts AS (SELECT n, page_id, translate(regexp_extract(r,'(?s)^[^/?#]*'),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(r, length(regexp_extract(r,'(?s)^[^/?#]*'))+1),'(?s)^[^?#]*') AS path FROM rest),
fit AS (SELECT n, arg_max(rhost || rpath, (length(rhost)+length(rpath))*1000+length(rhost)) AS rule, arg_max(verdict, (length(rhost)+length(rpath))*1000+length(rhost)) AS verdict
  FROM parts, {_ENTRIES} WHERE (host = rhost OR ends_with(host, '.'||rhost)) AND starts_with(path, rpath) GROUP BY n),
words AS (SELECT unnest(string_split('{LIST_WORDS}', ' ')) AS word),
listed AS (SELECT a.word || '-' || b.word || '.' || domain AS bhost, '/' AS bpath FROM words a, words b, {_DOMAINS} WHERE a.word <> b.word),
suffix AS (SELECT n, path, array_to_string(list_slice(string_split(host, '.'), k, len(string_split(host, '.'))), '.') AS bhost FROM parts, LATERAL (SELECT unnest(range(1, len(string_split(host, '.')) + 1)) AS k)),
ban AS (SELECT DISTINCT n FROM suffix JOIN listed USING (bhost) WHERE starts_with(path, bpath))
SELECT page_id, host, path, rule, coalesce(fit.verdict, CASE WHEN ban.n IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fit USING (n) LEFT JOIN ban USING (n)
"""
