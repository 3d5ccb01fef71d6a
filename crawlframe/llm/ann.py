"""Nearest neighbours by learned partitions (operator 4).

A bounded sample gives a neighbour graph. The graph is cut into balanced parts, and a small network learns to tell from
a vector the part of its neighbours. Every row is indexed under its most probable part; a query goes to
several most probable parts, and what is found there is ranked by exact cosine in double precision.

How many parts a query needs is not guessed: for a stated set of rows that the network has not seen, the true neighbours are
searched among all rows, and the probability that has to be covered before ``recall`` of them are met becomes
the limit up to which each query probes. Sure queries so go to few parts, and unsure ones to more.

Equal vectors are indexed once, with the smallest ids that an answer could need, so a vector that a third of all rows
share is one entry. Entries and queries of a part are dealt out in blocks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.llm.common import Workspace, only


@dataclass(frozen=True)
class Settings:
    #: Different vectors that a part should have about, and bound of the number of parts.
    part_rows: int = 256
    max_parts: int = 4096
    #: The graph and the network are learned from ``sample_rows`` rows, or ``rows_per_part`` for each part if that is more:
    #: 65,536 rows at most.
    sample_rows: int = 12_000
    rows_per_part: int = 16
    #: Rows whose true neighbours calibrate the probes, and the share of those neighbours that has to be met.
    probe_rows: int = 512
    recall: float = 0.96
    neighbours: int = 10
    hidden: int = 96
    epochs: int = 12
    #: Numbers in the vectors of a block of entries, and of a block of queries.
    block_values: int = 1 << 20
    seed: int = 11


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row, itself left out, by blocks of exact products."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        sims = x[a : a + 1024] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -np.inf
        out[a : a + 1024] = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cut the graph into parts of nearly equal size: seeds by distance, then label moves under a size limit.

    A move to the part of most of a row's neighbours is made while that part has room (five per cent more than
    its share), in random order, so few edges are cut and no part grows large.
    """
    n = len(x)
    if parts == 1:
        return np.zeros(n, np.int64)
    room = int(np.ceil(n / parts * 1.05)) + 1
    seeds = [int(rng.integers(n))]
    nearest = x @ x[seeds[0]]
    for _ in range(parts - 1):
        gap = np.maximum(1 - nearest, 1e-9)
        seeds.append(int(rng.choice(n, p=gap / gap.sum())))
        nearest = np.maximum(nearest, x @ x[seeds[-1]])
    centres = x[seeds]
    for _ in range(4):
        near, _ = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        there = np.bincount(near, minlength=parts) > 0
        centres[there] = unit(total[there] + 1e-12)
    near, sims = _nearest(x, centres)
    label, size = np.full(n, -1), np.zeros(parts, np.int64)
    for i in np.argsort(-sims):
        p = near[i]
        if size[p] >= room:
            p = int(np.where(size < room, centres @ x[i], -np.inf).argmax())
        label[i] = p
        size[p] += 1
    both = [set(row.tolist()) for row in graph]
    for i, row in enumerate(graph):
        for j in row:
            both[j].add(i)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(label[list(both[i])], minlength=parts)
            best = int(votes.argmax())
            if votes[best] > votes[label[i]] and size[best] < room:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if moved < n // 500:
            break
    return label


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(most similar centre, similarity) of each row, by blocks."""
    best, sims = np.empty(len(x), np.int64), np.empty(len(x))
    for a in range(0, len(x), 1024):
        block = x[a : a + 1024] @ centres.T
        best[a : a + 1024] = block.argmax(1)
        sims[a : a + 1024] = block.max(1)
    return best, sims


@dataclass
class Router:
    """A network of one hidden layer that gives the probability of each part."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def learn(x: np.ndarray, parts: int, settings: Settings) -> Router:
    """Fit the router to the parts of each sample row's neighbours (soft labels), with Adam in numpy."""
    rng = np.random.default_rng(settings.seed)
    dim = x.shape[1]
    parts = max(1, min(parts, len(x) // 4))
    if parts == 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, min(settings.neighbours, len(x) - 1))
    label = balanced_parts(x, graph, parts, rng)
    goals = np.concatenate([label[graph], label[:, None]], axis=1)
    net = [rng.normal(0, (2 / dim) ** 0.5, (dim, settings.hidden)), np.zeros(settings.hidden), rng.normal(0, settings.hidden**-0.5, (settings.hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], 0
    for _ in range(settings.epochs):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.maximum(x[batch] @ net[0] + net[1], 0)
            z = h @ net[2] + net[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            np.subtract.at(p, (np.repeat(np.arange(len(batch)), goals.shape[1]), goals[batch].ravel()), 1 / goals.shape[1])
            p /= len(batch)
            back = (p @ net[2].T) * (h > 0)
            grads = [x[batch].T @ back, back.sum(0), h.T @ p, p.sum(0)]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                net[i] = net[i] - 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*net)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of rows that take part: not null, not zero, and finite in every component."""
    rows = only(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, summed row by row, so equal rows get equal values."""
    q, x = scaled(q[None])[0], scaled(x)
    return (x * q).sum(1) / np.sqrt((x * x).sum(1) * (q * q).sum())


def _best(ids: list, vectors: list, queries: list, query_vectors: list, k: int) -> list[tuple]:
    """(query, id, score) of the k nearest of each query in a block; a query never finds its own id."""
    x, asked, out = np.array(vectors), np.array(query_vectors), []
    norms = unit(x)
    for a in range(0, len(asked), step := max(1, (1 << 21) // len(x))):
        near = unit(asked[a : a + step]) @ norms.T
        floors = np.partition(near, max(0, len(x) - k - 1), axis=1)[:, max(0, len(x) - k - 1)]
        for q, v, row, floor in zip(queries[a : a + step], asked[a : a + step], near, floors):
            found, take = {}, k + 1
            while True:
                rows = np.flatnonzero(row >= floor - 1e-9)
                for s, i in sorted((-s, i) for r, s in zip(rows, cosines(v, x[rows])) for i in ids[r] if i != q):
                    found.setdefault(i, s)
                if len(found) >= k or len(rows) == len(x):
                    break
                found, take = {}, min(2 * take, len(x))  # ids that repeat leave too few: look further
                floor = np.partition(row, len(x) - take)[len(x) - take]
            out += [(q, i, -s) for i, s in list(found.items())[:k]]
    return out


@dataclass
class Index:
    """Entries (embedding, ids, part), and what routes a query to parts."""

    entries: DataFrame
    router: Broadcast
    #: Entries and ids of each part that has any.
    sizes: dict[int, tuple[int, int]]
    #: A part is probed while the parts before it cover no more than this.
    mass: float
    dims: int
    k: int
    settings: Settings

    def route(self, queries: DataFrame) -> DataFrame:
        """(query_id, query, parts) of (vec_id, embedding): the parts to probe, which hold enough ids for a full answer."""
        router, mass, k = self.router, self.mass, self.k

        def run(batches):
            import pandas as pd

            held = np.array([self_sizes.get(p, (0, 0))[1] for p in range(len(router.value.b2))])
            for pdf in batches:
                p = router.value.probabilities(unit(np.array(pdf["embedding"].tolist())))
                best = np.argsort(-p, axis=1, kind="stable")
                before = _before(p, best)
                enough = np.cumsum(held[best], axis=1)
                need = (before <= mass) | (enough - held[best] < k + 1)  # one of the ids may be the query itself
                parts = [row[use & (held[row] > 0)].tolist() for row, use in zip(best, need)]
                yield pd.DataFrame({"query_id": pdf["vec_id"], "query": pdf["embedding"], "parts": parts})

        self_sizes = self.sizes
        return queries.mapInPandas(run, "query_id long, query array<double>, parts array<int>")

    def rank(self, routes: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of the k nearest in the parts of each query, by blocks of both sides."""
        spark, k, dims = routes.sparkSession, self.k, self.dims
        room = max(256, self.settings.block_values // dims)
        asked = routes.select(F.explode("parts").alias("part")).groupBy("part").agg(F.ceil(F.count("*") / room).cast("int").alias("query_blocks"))
        sizes = spark.createDataFrame([(p, -(-n // room)) for p, (n, _) in self.sizes.items()], "part int, blocks int")
        grid = F.broadcast(sizes.join(asked, "part"))  # a row for each part
        every = F.sequence(F.lit(0), F.col("query_blocks") - 1)
        left = self.entries.join(grid, "part").select("part", F.pmod(F.xxhash64("embedding"), "blocks").cast("int").alias("block"), F.explode(every).alias("query_block"), "embedding", "ids")
        right = routes.select("query_id", "query", F.explode("parts").alias("part")).join(grid, "part")
        right = right.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int").alias("query_block"), "query_id", "query")

        def run(key, entries, queries):
            import pandas as pd

            if not len(entries) or not len(queries):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            rows = _best(entries["ids"].tolist(), entries["embedding"].tolist(), queries["query_id"].tolist(), queries["query"].tolist(), k)
            return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

        keys = ["part", "block", "query_block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)

    def scanned(self, routes: DataFrame) -> float:
        """Share of all entries that a query is compared with, on average."""
        sizes = F.create_map(*[F.lit(x) for p, (n, _) in self.sizes.items() for x in (p, n)])
        own = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.element_at(sizes, p))
        return routes.agg(F.avg(own)).first()[0] / sum(n for n, _ in self.sizes.values())


def _before(p: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Probability that the parts before each one, in the order ``best``, cover."""
    sorted_ = np.take_along_axis(p, best, 1)
    return np.cumsum(sorted_, axis=1) - sorted_


def _draw(entries: DataFrame, rows: int, n: int, settings: Settings) -> np.ndarray:
    """Vectors of ``rows`` entries by the order of a hash; tasks hand on about twice as many, however many they are."""
    drawn = entries.withColumn("_h", F.xxhash64(F.lit(settings.seed), "embedding"))
    if n > 4 * rows:
        drawn = drawn.filter(F.col("_h") < int(2**64 * 2 * rows / n) - 2**63)
    return np.array([r.embedding for r in drawn.orderBy("_h", "embedding").limit(rows).toLocalIterator()])


def _calibrate(placed: DataFrame, router: Broadcast, probes: np.ndarray, k: int, settings: Settings) -> float:
    """Mass that has to be covered for ``recall`` of the true neighbours of ``probes``, a stated set against all rows."""
    spark = placed.sparkSession
    handle = spark.sparkContext.broadcast(unit(probes))  # probe_rows vectors

    def run(batches):
        import pandas as pd

        for pdf in batches:
            x, part = unit(np.array(pdf["embedding"].tolist())), pdf["part"].to_numpy()
            for a in range(0, len(x), 4096):
                sims = handle.value @ x[a : a + 4096].T
                take = min(sims.shape[1], k + 1)
                best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
                yield pd.DataFrame({"probe": np.repeat(np.arange(len(sims)), take), "near": np.take_along_axis(sims, best, 1).ravel(), "part": part[a : a + 4096][best].ravel()})

    nearest = Window.partitionBy("probe").orderBy(F.desc("near"), "part")
    found = placed.mapInPandas(run, "probe int, near double, part int").withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= k + 1)
    pairs = [(r.probe, r.part) for r in found.filter("nth > 1").collect()]  # the first one is the probe itself; k rows a probe
    p = router.value.probabilities(unit(probes))
    best = np.argsort(-p, axis=1, kind="stable")
    before = np.empty_like(p)
    np.put_along_axis(before, best, _before(p, best), 1)
    return float(np.quantile([before[i, part] for i, part in pairs], settings.recall, method="higher")) if pairs else 1.0


def build(vectors: DataFrame, k: int = 5, settings: Settings = Settings(), work: Workspace | None = None) -> Index | None:
    """Learn the parts and index every row of ``vectors`` (vec_id, embedding); None where no row takes part."""
    spark = vectors.sparkSession
    work = work or Workspace(spark, "ann")
    good = valid(vectors)
    dims = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return None
    order = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = good.filter(F.size("embedding") == dims.d).dropDuplicates(["vec_id", "embedding"]).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    entries = work.save(ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    n = entries.count()
    parts = min(settings.max_parts, -(-n // settings.part_rows))
    rows = max(settings.sample_rows, settings.rows_per_part * parts)
    sample = _draw(entries, rows + settings.probe_rows, n, settings)
    kept = len(sample) - min(settings.probe_rows, len(sample) // 8)
    router = spark.sparkContext.broadcast(learn(unit(sample[:kept]), parts, settings))  # of a size that settings bound

    def place(batches):
        for pdf in batches:
            yield pdf.assign(part=router.value.logits(unit(np.array(pdf["embedding"].tolist()))).argmax(1))

    placed = work.save(entries.mapInPandas(place, "embedding array<double>, ids array<long>, part int"), "placed")
    work.drop("entries")
    sizes = {r.part: (r.n, r.held) for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("held")).collect()}
    mass = _calibrate(placed, router, sample[kept:], k, settings) if len(sizes) > 1 and kept < len(sample) else 1.0
    return Index(placed, router, sizes, mass, dims.d, k, settings)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row (vec_id, embedding).

    Nearness is the cosine in double precision; ties go to the smaller vec_id; a query's own id never answers it.
    Null vectors, zero vectors and those with null or non-finite components take no part, nor do rows without an id or
    of another length than most. Repeated rows count once. Where a vec_id has several vectors, each is a candidate, and an answer
    lists the id once, with its best score; as a query it stands with the smallest of them. Answers hold k rows unless there are fewer
    candidates: queries whose parts hold too few different ids are searched in every part. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "ann")
    index = build(vectors, k, settings, work)
    result = ["query_id", "rank", "vec_id", "score"]
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = valid(queries).filter(F.size("embedding") == index.dims).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    routes = work.save(index.route(asked), "routes")
    found = work.save(index.rank(routes).select(*result), "found")
    if len(index.sizes) == 1:
        return found
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") == k).select("query_id")
    short = routes.join(full, "query_id", "left_anti")
    if short.isEmpty():
        return found
    every = short.withColumn("parts", F.array(*[F.lit(p) for p in sorted(index.sizes)]))
    return found.join(full, "query_id", "left_semi").unionByName(index.rank(work.save(every, "short")).select(*result))
