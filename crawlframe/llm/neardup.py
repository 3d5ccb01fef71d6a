"""MinHash near-duplicate detection with odd sketches (operator 3).

Exact copies collapse into classes by a digest of their shingle sets. Every class gets MinHash samples, bands of them
as bucket keys, and an odd sketch: the samples folded into a parity bitmap. The bits in which two bitmaps differ
estimate the similarity sharply where it is high, so the sketches settle most candidates without their texts; links
are confirmed on full shingle sets only.

Groups of any size stay cheap. A bucket ties its members to a pivot, the one with the smallest share of shingles of
its own, and what stays apart to another pivot, which is linear in the bucket. Components of
confirmed links follow by alternating star contraction. Where a bucket still spans several components, members outside the
largest one are compared with members of other components, so no link between different texts is lost; shingles
that only one text has bound the similarity of each such pair exactly, before its sets are looked at.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import Workspace, only, slices
from crawlframe.llm.words import byte_word_hashes, mixed

SAMPLES, BANDS = 96, 24
ROWS = SAMPLES // BANDS
BITS = 512
#: Rounds of pivots before what is left is compared in full.
PIVOTS = 3
#: Shingles of so many open texts at most are rare; pairs that share one are listed by shingle.
RARE = 64
#: Members of a bucket, or rows of a class, that one task takes about where facts of the whole meet them.
SHARE = 256
_WORDS = BITS // 64
GROUP = 2 << 20
_rng = np.random.default_rng(20240101)
_A = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; documents are linked where 100 * intersection >= ``percent`` * union."""

    words: int = 5
    percent: int = 80

    def linked(self, inter: int, a: int, b: int) -> bool:
        return 100 * inter >= self.percent * (a + b - inter)

    @property
    def most_bits(self) -> int:
        """Differing bits that a linked pair exceeds with a chance below 1e-11: seven deviations more samples
        differ than expected, and each of those flips two bits."""
        j = self.percent / 100
        return 2 * math.ceil(SAMPLES * (1 - j) + 7 * math.sqrt(SAMPLES * j * (1 - j)))


def estimate(bits: int) -> float:
    """Similarity that an odd sketch estimates from the number of differing bits."""
    return 1.0 if 2 * bits >= BITS else 1 + BITS / (4 * SAMPLES) * math.log(1 - 2 * bits / BITS)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the different shingles of each text, A-Z in lower case.

    With fewer words than ``words`` the whole sequence is one shingle; without words the set is empty.
    """
    hashes, counts = byte_word_hashes([t.encode() for t in texts], _INSIDE, b" ")
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        rolled = mixed(rolled + hashes[k : len(hashes) - words + 1 + k] + np.uint64(k + 1))
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(rolled[at : at + n - words + 1]))
        elif n:
            h = np.array([n], np.uint64)
            for x in hashes[at : at + n]:
                h = mixed(mixed(h) + x)
            out.append(h)
        else:
            out.append(hashes[:0])
        at += n
    return out


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of one set, in blocks so that memory stays bounded."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        block = shingles[at : at + 4096]
        np.minimum(least, np.stack([(block * a + b).min() for a, b in zip(_A, _B)]) if len(block) > 512 else (block[:, None] * _A + _B).min(0), out=least)
    return least


def sketch(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketches) of rows of samples."""
    tagged = mixed(least + np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bit = (tagged >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    flips = np.bincount((np.arange(len(least))[:, None] * BITS + bit).ravel(), minlength=len(least) * BITS)
    odd = np.packbits((flips & 1).astype(np.uint8)).view(np.int64).reshape(len(least), _WORDS)
    key = np.zeros((len(least), BANDS), np.uint64)
    for k in range(ROWS):
        key = mixed(key + tagged[:, k::ROWS])
    return key.view(np.int64), odd


def profile(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, text, n, digest, bands, odd) of each row; no digest or bands where the set is empty."""
    def run(batches):
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in slices([len(t) + 1 for t in texts], GROUP):
                sets = shingle_sets(texts[a:b], rule.words)
                least = np.stack([samples(s) for s in sets])
                bands, odd = sketch(least)
                full = [len(s) > 0 for s in sets]
                yield pdf.iloc[a:b][["doc_id", "text"]].assign(
                    n=[len(s) for s in sets],
                    digest=[hashlib.blake2b(s.tobytes(), digest_size=16).digest() if f else None for s, f in zip(sets, full)],
                    bands=[x if f else None for x, f in zip(bands, full)],
                    odd=[x if f else None for x, f in zip(odd, full)],
                )

    rows = only(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, text string, n long, digest binary, bands array<long>, odd array<long>")


def _near(a: str, b: str, rule: Rule):
    """Sizes, shared shingles and sketches of two classes allow for a link."""
    bits = " + ".join(f"bit_count({a}.odd[{k}] ^ {b}.odd[{k}])" for k in range(_WORDS))
    most = f"least({a}.common, {b}.common)"
    return F.expr(f"100 * {most} >= {rule.percent} * ({a}.n + {b}.n - {most}) and {bits} <= {rule.most_bits}")


def _dealt(facts: DataFrame) -> DataFrame:
    """Facts of buckets (key, salts, ...), one for each share of a bucket, so that a large one is not one task."""
    return facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _possible(pairs: DataFrame, facts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that pass :func:`_near`."""
    both = pairs.join(facts.alias("x"), F.col("a") == F.col("x.id")).join(facts.alias("y"), F.col("b") == F.col("y.id"))
    return both.filter(_near("x", "y", rule)).select("a", "b")


def _shingles(texts: DataFrame, rule: Rule) -> DataFrame:
    """(id, shingle): the 64-bit hash of each different shingle of each text; a clash makes two of them one."""
    def run(batches):
        for pdf in batches:
            for a, b in slices((pdf["text"].str.len() + 1).tolist(), GROUP):
                sets = shingle_sets(pdf["text"].iloc[a:b].tolist(), rule.words)
                yield pdf.iloc[a:b][["id"]].assign(shingles=[x.view(np.int64) for x in sets])

    return texts.mapInPandas(run, "id long, shingles array<long>").select("id", F.explode("shingles").alias("shingle"))


def _own_shingles(texts: DataFrame, rule: Rule) -> DataFrame:
    """(id, own): how many shingles of each text no other text here has.

    Two texts can't share those, which bounds their similarity exactly. Clashes of shingles only make the number smaller,
    so the bound stays safe. One row for each shingle of each task is shuffled.
    """
    alone = _shingles(texts, rule).groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("other")).filter("id = other")
    own = alone.groupBy("id").agg(F.count("*").alias("own"))
    return texts.select("id").join(own, "id", "left").select("id", F.coalesce("own", F.lit(0)).alias("own"))


def _apart(open_: DataFrame, texts: DataFrame, rule: Rule, work: Workspace) -> DataFrame:
    """(a, b): every pair of open texts of one bucket and different components that may still be linked.

    A pair either shares a rare shingle, and then is listed under it, which takes ``RARE`` rows for each place of a shingle at
    most; or it shares none, and then all rare shingles of either one are missing in the other. That bound leaves few
    texts of a bucket to compare.
    """
    one = open_.select("id", "root", "n", "common", "odd").dropDuplicates(["id"])
    shingles = work.save(_shingles(texts.join(one.select("id"), "id", "left_semi"), rule), "shingles")
    seldom = shingles.groupBy("shingle").agg(F.count("*").alias("df")).filter(F.col("df") <= RARE)
    held = work.save(shingles.join(seldom, "shingle"), "rare")
    listed = held.filter("df > 1").select("id", "shingle").join(one, "id")
    sharing = listed.alias("x").join(listed.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & _near("x", "y", rule))
    rare = held.groupBy("id").agg(F.count("*").alias("rare"))
    left = open_.join(rare, "id", "left").withColumn("common", F.col("n") - F.coalesce("rare", F.lit(0))).filter(_able(rule))
    minor = left.filter("root <> major")
    without = minor.alias("x").join(left.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _near("x", "y", rule))
    pair = (F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return sharing.select(*pair).unionByName(without.select(*pair)).distinct()


def _able(rule: Rule):
    """The most that a text can share still allows for a link with the smallest text of its bucket."""
    return F.col("common") * 100 >= rule.percent * (F.col("n") + F.greatest("least_n", "common") - F.col("common"))


def _confirmed(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            for begin, end in slices((pdf["ta"].str.len() + pdf["tb"].str.len()).tolist(), GROUP):
                part = pdf.iloc[begin:end]
                known = dict(zip(part["a"], part["ta"])) | dict(zip(part["b"], part["tb"]))
                sets = dict(zip(known, shingle_sets(list(known.values()), rule.words)))
                good = []
                for a, b in zip(part["a"], part["b"]):
                    x, y = sets[a], sets[b]
                    good.append(rule.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
                yield pd.DataFrame({"a": part["a"], "b": part["b"]})[good]

    left = pairs.join(texts.hint("merge").select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.hint("merge").select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(id, root): the smallest node of each node's component, by alternating large and small stars.

    Each step gives every node's links to the smallest neighbour, in the form of a minimum and a join, so no
    neighbourhood is gathered. Nodes without edges are left out.
    """
    links = work.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}0")
    before, turn = None, 0
    while True:
        turn += 1
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        links = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        links = work.save(links.filter("u <> v").distinct(), f"{name}{turn}")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"{name}{turn - 1}")
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("u"), "v").distinct()
    return links.unionByName(roots).select(F.col("u").alias("id"), F.col("v").alias("root"))


def cluster(docs: DataFrame, rule: Rule = Rule(), work: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    ``component_id`` is the smallest doc_id that links lead to. A null or empty text, or one without words, has
    no shingles and is linked with nothing. Null doc_ids count as the largest; a component of such rows
    alone has a null id, and its rows are kept. Rows that repeat doc_id and text are copies of each other and all
    carry the same result. An empty table gives an empty result.
    """
    work = work or Workspace(docs.sparkSession, "neardup")
    rows = work.save(profile(docs, rule).withColumn("rid", F.monotonically_increasing_id()), "profile")
    full = rows.filter("n > 0")
    classes = full.groupBy("digest", "n", "bands", "odd").agg(F.min("doc_id").alias("doc_id"), F.min("rid").alias("id"))
    classes = work.save(classes, "classes")
    slim = classes.select("id", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "id")
    buckets = slim.groupBy("key").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("salts"), F.count("*").alias("members")).filter("members > 1").drop("members")
    shared = slim.join(buckets, "key").withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int"))
    shared = work.save(shared, "shared")
    texts = rows.select(F.col("rid").alias("id"), "text").hint("merge").join(shared.select("id").distinct(), "id", "left_semi")
    texts = work.save(texts, "texts")
    facts = classes.select("id", "n", "odd").join(_own_shingles(texts, rule), "id").select("id", "n", "odd", (F.col("n") - F.col("own")).alias("common"))
    facts = work.save(facts, "facts")
    left = work.save(shared.join(facts, "id").select("key", "salts", "salt", "id", "n", "common"), "left0")
    links = None
    for turn in range(PIVOTS):
        oddest = F.struct((1 - F.col("common") / F.col("n")).alias("share"), "id")
        pivots = left.groupBy("key").agg(F.min_by("id", oddest).alias("pivot"), F.count("*").alias("members"), F.max("salts").alias("salts")).filter("members > 1")
        pivots = _dealt(pivots.drop("members"))
        tried = left.select("key", "salt", "id").join(pivots, ["key", "salt"]).filter("id <> pivot")
        pairs = tried.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        found = work.save(_confirmed(work.save(_possible(pairs, facts, rule), f"near{turn}"), texts, rule), f"links{turn}")
        links = found if links is None else links.unionByName(found)
        if turn + 1 < PIVOTS:
            tied = found.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(found.select(F.col("b").alias("x"), F.col("a").alias("y")))
            open_ = left.join(pivots, ["key", "salt"]).filter("id <> pivot")
            open_ = open_.join(tied, (F.col("id") == F.col("x")) & (F.col("pivot") == F.col("y")), "left_anti")
            left = work.save(open_.select("key", "salts", "salt", "id", "n", "common"), f"left{turn + 1}")
    roots = work.save(components(links, work, "star"), "roots")

    rooted = shared.join(roots, "id", "left").select("key", "salts", "salt", "id", F.coalesce("root", "id").alias("root")).join(facts, "id")
    spread = rooted.groupBy("key", "root").agg(F.count("*").alias("c"), F.min("n").alias("n"), F.max("salts").alias("salts")).groupBy("key")
    spread = spread.agg(F.count("*").alias("roots"), F.min("n").alias("least_n"), F.max_by("root", F.struct("c", "root")).alias("major"), F.max("salts").alias("salts")).filter("roots > 1")
    open_ = work.save(rooted.drop("salts").join(_dealt(spread.drop("roots")), ["key", "salt"]).filter(_able(rule)).select("key", "id", "root", "major", "n", "common", "odd", "least_n"), "open")
    rest = work.save(_apart(open_, texts, rule, work), "rest")
    if not rest.isEmpty():
        more = work.save(_confirmed(rest, texts, rule), "more_links")
        roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more), work, "again")

    named = classes.select("digest", "id", "doc_id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    verdict = work.save(named.join(smallest, "root").select("digest", "component_id"), "verdict")
    work.keep("profile", "verdict")
    result = full.select("doc_id", "n", "digest", F.pmod(F.hash("rid"), F.lit(64)).alias("salt"))
    cells = result.select("digest", "salt").distinct().join(verdict, "digest")  # rows of a class meet its verdict in shares
    result = result.join(cells, ["digest", "salt"]).select("doc_id", "n", "component_id")
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return result.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` with one row of each component: those whose doc_id names it. Columns are unchanged.

    Rows that repeat the doc_id of a kept row stay with it; rows with a null doc_id can't be told apart and are all kept.
    """
    verdict = cluster(docs, rule).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.filter("doc_id is null").unionByName(docs.filter("doc_id is not null").join(verdict, "doc_id", "left_semi"))


ORACLE = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from words where len(w) > 0)
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
classes as (
  select doc_id, n, min(doc_id) over (partition by content) as rep
  from (select s.doc_id, z.n, md5(string_agg(s, chr(10) order by s)) as content from shingles s join sizes z on s.doc_id = z.doc_id group by s.doc_id, z.n)
), own as (
  select s.doc_id, s.s, c.n from shingles s join classes c on s.doc_id = c.doc_id where c.doc_id = c.rep
), pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as inter, any_value(a.n) as na, any_value(b.n) as nb
  from own a join own b on a.s = b.s and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id
), links as (
  select x, y from pairs where 100 * inter >= 85 * (na + nb - inter)
), both_ways as (select x, y from links union all select y, x from links),
reach as (
  select x, x as y from both_ways union select r.x, l.y from reach r join both_ways l on r.y = l.x
), roots as (select x, min(y) as root from reach group by x)
select d.doc_id, coalesce(c.n, 0) as n_shingles, coalesce(r.root, c.rep, d.doc_id) as component_id,
  d.doc_id = coalesce(r.root, c.rep, d.doc_id) as kept
from documents d left join classes c on d.doc_id = c.doc_id left join roots r on c.rep = r.x
"""
