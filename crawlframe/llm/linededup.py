"""Removal of repeated line runs (operator 2), with DataFrame operations alone.

Lines become line ids, documents sequences of them. Distributed prefix doubling builds the suffix array level by
level: the rank of 2^(k+1) lines is the place of the pair (rank of the first 2^k, rank of the next 2^k) in a
range-sorted table of all pairs. Suffixes that share their first m lines are one longest-common-prefix interval;
it is named by two overlapping ranks of level floor(log2 m). A run of lines is long
enough if it has ``min_words`` words. Every run whose interval also holds an earlier place is a copy, and
its lines are deleted; runs that overlap or continue each other make up the maximal runs.

Lines and pairs that occur once fall out of each round, so the table that goes round shrinks quickly. A line, pair or passage that
many documents share meets its rank, or its first place, in many tasks. Lines are told apart by 128 bits of hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.llm.common import Workspace, only

MIN_WORDS = 50
#: A key that more than one row in so many has is heavy; there can't be more heavy keys than this.
HEAVY = 1000
#: Shares that rows of a heavy key are dealt out in.
WAYS = 64


def _ranked(keys: DataFrame, names: list[str], rank: str) -> DataFrame:
    """``keys`` (all different) with an ascending number: range partitions, each sorted, numbered in order."""
    return keys.repartitionByRange(*names).sortWithinPartitions(*names).withColumn(rank, F.monotonically_increasing_id())


def _repeated(rows: DataFrame, names: list[str], work: Workspace, name: str) -> DataFrame:
    """Ranks of the values of ``names`` that occur twice or more in ``rows``, and how often."""
    keys = rows.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1")
    return work.save(_ranked(keys, names, "rank"), name)


def _with_rank(rows: DataFrame, ranks: DataFrame, names: list[str], total: int) -> DataFrame:
    """``rows``, of which there are ``total`` at most, with the rank of their key; rows of a heavy key are dealt out."""
    heavy = F.broadcast(ranks.filter(F.col("n") > total / HEAVY).select(*names, F.lit(WAYS).alias("ways")))  # HEAVY rows at most
    ways = F.coalesce("ways", F.lit(1))
    left = rows.join(heavy, names, "left").withColumn("share", F.pmod(F.hash("rid", "pos"), ways)).drop("ways")
    right = ranks.join(heavy, names, "left").withColumn("share", F.explode(F.sequence(F.lit(0), ways - 1))).drop("ways", "n")
    return left.join(right, [*names, "share"])


def _with_first(named: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the first place of their key, where several have it; a share of each key is aggregated on its own first."""
    shared = named.withColumn("share", F.pmod(F.hash("rid"), F.lit(WAYS)))
    parts = shared.groupBy(*names, "share").agg(F.min(F.struct("place", "pos")).alias("first"), F.count("*").alias("n"))
    first = parts.groupBy(*names).agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    return shared.join(parts.select(*names, "share").join(first, names), [*names, "share"])


def _windows(active: DataFrame, min_words: int) -> DataFrame:
    """(rid, pos, size): shortest runs with enough words that begin, or end, at each place of repeated lines.

    Words are summed up before each place. Places and the sums that are looked for are sorted together, and a
    running minimum or maximum finds the partner, so a document costs a sort however long it is.
    """
    run = Window.partitionBy("rid", "run").orderBy("pos")
    summed = active.select("rid", "run", "pos", (F.sum("words").over(run) - F.col("words")).alias("before"), F.sum("words").over(run).alias("until"))
    ends = summed.groupBy("rid", "run").agg((F.max("pos") + 1).alias("pos"), F.max("until").alias("before"))
    places = summed.select("rid", "run", "pos", "before").unionByName(ends)
    points = places.select("rid", "run", F.explode(F.array(
        F.struct(F.col("before").alias("value"), F.lit(0).alias("kind"), "pos"),
        F.struct((F.col("before") + min_words).alias("value"), F.lit(1).alias("kind"), "pos"),
        F.struct((F.col("before") - min_words).alias("value"), F.lit(2).alias("kind"), "pos"),
    )).alias("p")).select("rid", "run", "p.*")
    place = F.when(F.col("kind") == 0, F.col("pos"))
    span = (Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("rid", "run").orderBy(F.col("value").desc(), "kind", "pos").rowsBetween(*span)
    upto = Window.partitionBy("rid", "run").orderBy("value", "kind", "pos").rowsBetween(*span)
    met = points.select("rid", "kind", "pos", F.min(place).over(after).alias("end"), F.max(place).over(upto).alias("begin"))
    begin = F.when(F.col("kind") == 1, F.col("pos")).otherwise(F.col("begin"))
    end = F.when(F.col("kind") == 1, F.col("end")).otherwise(F.col("pos"))
    found = met.filter("kind > 0").select("rid", begin.alias("pos"), (end - begin).alias("size"))
    return found.filter("size > 0").dropDuplicates(["rid", "pos", "size"])


def repeats(lines: DataFrame, work: Workspace, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, begin, end): maximal stretches of lines to delete, of ``lines`` (rid, place, pos, h1, h2, words).

    ``place`` orders documents. A stretch is a union of runs with at least ``min_words`` words whose lines also
    stand, in the same order, at an earlier place; copies may overlap their originals.
    """
    total = lines.count()
    names = _repeated(lines, ["h1", "h2"], work, "names")
    marked = _with_rank(lines, names, ["h1", "h2"], total).select("rid", "place", "pos", "words", "rank")
    in_doc = Window.partitionBy("rid").orderBy("pos")
    active = marked.withColumn("run", F.col("pos") - F.row_number().over(in_doc))
    active = work.save(active, "active")
    windows = work.save(_windows(active, min_words).join(active.select("rid", "pos", "place"), ["rid", "pos"]), "windows")
    longest = windows.agg(F.max("size")).first()[0] or 0
    ranks, size, level, copies = active.select("rid", "pos", "rank"), 1, 0, []
    while size <= longest:
        own = windows.filter((F.col("size") >= size) & (F.col("size") < 2 * size))
        second = ranks.select("rid", F.col("pos").alias("pos2"), F.col("rank").alias("rank2"))
        named = own.withColumn("pos2", F.col("pos") + F.col("size") - size).join(ranks, ["rid", "pos"]).join(second, ["rid", "pos2"])
        later = _with_first(named, ["size", "rank", "rank2"]).filter(F.struct("place", "pos") != F.col("first"))
        copies.append(work.save(later.select("rid", F.col("pos").alias("begin"), (F.col("pos") + F.col("size")).alias("end")), f"copies{level}"))
        if 2 * size <= longest:
            pairs = ranks.withColumnRenamed("rank", "a").join(ranks.select("rid", (F.col("pos") - size).alias("pos"), F.col("rank").alias("b")), ["rid", "pos"])
            pairs = work.save(pairs, f"pairs{level}")
            found = _repeated(pairs, ["a", "b"], work, f"ranks{level}")
            ranks = work.save(_with_rank(pairs, found, ["a", "b"], total).select("rid", "pos", "rank"), f"level{level + 1}")
        size, level = 2 * size, level + 1
    if not copies:
        return windows.select("rid", F.col("pos").alias("begin"), F.col("pos").alias("end")).limit(0)
    every = copies[0]
    for more in copies[1:]:
        every = every.unionByName(more)
    reach = F.max("end").over(Window.partitionBy("rid").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    cut = every.withColumn("new", F.when(F.col("begin") <= reach, 0).otherwise(1))
    group = F.sum("new").over(Window.partitionBy("rid").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("stretch", group).groupBy("rid", "stretch").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("stretch")


_KEPT = """
element_at(transform(array(split(text, '\\n')), lines -> array_join(flatten(transform(sequence(0, size(cuts)), i ->
  slice(lines, if(i = 0, 0, cuts[i - 1].end) + 1, if(i = size(cuts), size(lines), cuts[i].begin) - if(i = 0, 0, cuts[i - 1].end)))), '\\n')), 1)
"""


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of line runs taken out of ``text``, and columns n_lines and n_removed.

    Documents are ordered by doc_id (null last), and rows with the same doc_id as they are read; the first
    place of a run stays. Lines end at line feeds; words are stretches without white space. A null text stays
    null and has no lines; an empty one has one empty line. Repeated rows are documents of their own, so the second one
    loses its runs. Other columns are handed through; n_lines and n_removed replace columns of these names.
    """
    work = Workspace(docs.sparkSession, "lines")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    numbered = work.save(only(docs, *kept).withColumn("_rid", F.monotonically_increasing_id()), "documents")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("_rid").alias("row"))
    split = numbered.filter("text is not null").select(F.col("_rid").alias("rid"), place.alias("place"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = split.select("rid", "place", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.regexp_count("line", F.lit(r"\S+")).cast("long").alias("words"))
    stretches = repeats(work.save(lines, "lines"), work, min_words)
    work.keep("documents", "windows", "copies")
    cuts = stretches.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("cuts"), F.sum(F.col("end") - F.col("begin")).alias("_removed"))
    found = numbered.join(cuts.withColumnRenamed("rid", "_rid"), "_rid", "left")
    text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.expr(_KEPT))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return found.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in kept], n_lines.cast("long").alias("n_lines"), F.coalesce("_removed", F.lit(0)).cast("long").alias("n_removed"))


ORACLE = r"""
with lines as (
  select doc_id, i as pos, l[i] as line, cast(len(regexp_extract_all(l[i], '[^\x20\x09-\x0D]+')) as bigint) as words
  from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null))
), often as (
  select line from lines group by line having count(*) > 1
), active as (
  select *, pos - row_number() over (partition by doc_id order by pos) as run from lines where line in (select line from often)
), sums as (
  select *, sum(words) over (partition by doc_id, run order by pos) as until from active
), spans as (
  select a.doc_id, a.pos as b, c.pos as e, c.until - a.until + a.words as total, a.words as first_words, c.words as last_words
  from sums a join sums c on a.doc_id = c.doc_id and a.run = c.run and a.pos <= c.pos
), minimal as (
  select doc_id, b, e from spans where total >= 50 and (total - last_words < 50 or total - first_words < 50)
), texts as (
  select m.doc_id, b, e, md5(string_agg(line, chr(10) order by pos)) as content, e - b as size
  from minimal m join lines l on l.doc_id = m.doc_id and l.pos between b and e group by m.doc_id, b, e
), copies as (
  select * from (select *, row_number() over (partition by content, size order by doc_id, b) as n from texts) where n > 1
), gone as (
  select distinct doc_id, unnest(range(b, e + 1)) as pos from copies
), kept as (
  select l.doc_id, string_agg(line, chr(10) order by l.pos) filter (g.pos is null) as text, count(*) as n_lines, count(g.pos) as n_removed
  from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id
)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
  coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed
from documents d left join kept k on d.doc_id = k.doc_id
"""
