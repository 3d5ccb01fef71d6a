"""Each operator against a brute-force version, on test tables and on edge cases."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from crawlframe.llm import ann, bpe, counts, decontam, langid, linededup, neardup, pii, queries, tokenfiles, warc
from crawlframe.llm.common import table
from tests.helpers import assert_same
from tests.llm.conftest import ROWS

SF = "/root/testdata/sf0.001"
TEXTS = [(i, t or "") for i, t, _ in ROWS]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    assert assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) > 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://b\r\nX: 1", None), (4, "u", ""), (4, "u", ""), (None, "u", "x"), (6, "u", "é\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha256 string")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect()}
    assert got == {(1, "response", None, 1), (2, "revisit", 1, 1), (None, "revisit", 1, 1), (3, "response", None, 0), (4, "revisit", 3, 0), (6, "response", None, 16)}
    warc.write(pages, f"file://{tmp_path}/a")
    warc.export(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/out")
    kinds = sorted(h.split(b"WARC-Type: ")[1].split(b"\r\n")[0] for h, _ in ((bytes(r.header), r.block) for r in warc.read_files(spark, f"file://{tmp_path}/out").collect()))
    assert len(kinds) == len(rows)
    bodies = {bytes(r.block) for r in warc.read_files(spark, f"file://{tmp_path}/out").collect()}
    assert "é\r\n\r\nWARC/1.1\r\n".encode() in bodies
    assert warc.round_trip(pages.filter("false")).count() == 0


def removed_by_force(docs: list[tuple[int, str]], least: int) -> dict[int, list[str]]:
    """Lines that stay: a run with enough words goes if it stands at an earlier place too."""
    seen, gone = set(), defaultdict(set)
    for doc, text in docs:
        lines = text.split("\n")
        size = [len(x.split()) for x in lines]
        for b in range(len(lines)):
            words, run = 0, 0
            for e in range(b, len(lines)):
                words, run = words + size[e], hash((run, lines[e]))
                if words >= least:
                    if run in seen:
                        gone[doc] |= set(range(b, e + 1))
                    seen.add(run)
    return {d: [x for k, x in enumerate(t.split("\n")) if k not in gone[d]] for d, t in docs}


def test_line_dedup_against_force(spark):
    rng = random.Random(4)
    docs = [(d, "\n".join(rng.choice(["a b", "c d e", "f", "g h i j", "k l"]) for _ in range(rng.randint(1, 14)))) for d in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.dedup(df, 6).collect()}
    for d, kept in removed_by_force(docs, 6).items():
        assert got[d].text == "\n".join(kept)
        assert got[d].n_lines - got[d].n_removed == len(kept)


def test_line_dedup_edges(docs, no_docs):
    got = linededup.dedup(docs).collect()
    assert len(got) == len(ROWS) and linededup.dedup(no_docs).count() == 0
    assert next(r for r in got if r.doc_id == 1).text is None


def clusters_by_force(docs, words: int, percent: int):
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def near_copies(count: int, seed: int):
    """A large group of copies with few or many edits of a base, and a chain, among others."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    docs = []
    for d in range(count):
        words = list(base) if d % 4 else [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(rng.randint(0, 7) if d % 4 else 0):
            at = rng.randrange(len(words))
            if rng.random() < 0.5:
                del words[at]
            else:
                words[at] = rng.choice(vocabulary)
        docs.append((d, " ".join(words)))
    return docs


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_near_dedup_against_force(spark, words, percent, seed):
    docs = [*near_copies(160, seed), (900, ""), (901, "one two"), (902, "One\ttwo")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in neardup.cluster(df, neardup.Rule(words, percent)).collect()}
    assert got == clusters_by_force(docs, words, percent)


def test_near_dedup_large_bucket(spark, monkeypatch):
    """Two thousand variants of one text in common buckets, few of them linked: pairs that are looked at stay few."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    docs = []
    for d in range(2000):
        words = list(base)
        for at in rng.sample(range(200), 12):
            words[at] = f"x{d}_{at}"
        docs.append((d, " ".join(words)))
    docs += [(5000 + d, t + " tail") for d, t in docs[:40]]
    tried = []

    def confirmed(pairs, texts, rule, inner=neardup._confirmed):
        tried.append(pairs.count())
        return inner(pairs, texts, rule)

    monkeypatch.setattr(neardup, "_confirmed", confirmed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in neardup.cluster(df, neardup.Rule(3, 85)).collect()}
    assert got == {(d, d - 5000 * (d >= 5000)) for d, _ in docs}
    assert sum(tried) <= 24 * neardup.PIVOTS * len(docs)


def test_near_dedup_edges(docs, no_docs):
    got = neardup.cluster(docs).collect()
    assert len(got) == len(ROWS) and neardup.cluster(no_docs).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[6].component_id == 5 and by[1].n_shingles == 0 and by[4].component_id == 3


def test_neighbours_recall(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = defaultdict(list)
    for r in ann.search(vectors, vectors.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    rows = vectors.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q, found in got.items():
        s = x @ x[np.searchsorted(ids, q)]
        best = [int(ids[k]) for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        hits, total = hits + len(set(best) & {v for v, _ in found}), total + 5
        assert [v for _, v in found] == sorted((v for _, v in found), reverse=True)
        assert all(abs(v - s[np.searchsorted(ids, i)]) < 1e-9 for i, v in found)
    assert total == 5 * sum(1 for r in rows if r.vec_id % 50 == 0) and hits >= 0.9 * total


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [1.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "p") for r in rows], "vec_id long, embedding array<float>, part string")
    got = ann.search(vectors, vectors.filter("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 7, 5]
    assert ann.search(vectors.filter("false"), vectors.filter("false")).count() == 0


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = langid.identify(docs).cache()
    got = found.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 0
    for r in found.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.lang_pred != "und" or (r.score == 0 and r.rejected)


def language_by_force(text: str, model: langid.Model) -> tuple[str, float]:
    """Mean over all n-grams, one at a time, of a table row, and the softmax of it."""
    signs, rows = [ord(c) for c in f" {text.lower()} "], []
    for i in range(len(signs)):
        h = 0
        for n in langid.ORDERS:
            if i + n <= len(signs):
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (signs[i + n - 1] * 0x9E3779B1 & 0xFFFFFFFF)
                rows.append(((h ^ h >> 15) * (0x2C1B3C6D + 2 * n) & 0xFFFFFFFF) >> 17)
    z = model.table[rows].mean(0)[:-1] / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.langs[p.argmax()], p.max()


def test_language_against_force(spark, monkeypatch):
    """Predictions and scores, also where texts are longer than a window."""
    docs = table(spark, SF, "documents")
    model = langid.fit(docs)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    force = {i: language_by_force(t, model) for i, t in texts if t and any(map(str.isalpha, t))}
    for r in langid.predict(docs, model).collect():
        if r.doc_id in force:
            assert r.lang_pred == force[r.doc_id][0] and abs(r.score - force[r.doc_id][1]) < 1e-9
    monkeypatch.setattr(langid, "GROUP", 17)
    sure = model.scores([t for i, t in texts if i in force][:40])[0].max(1)
    assert np.allclose(sure, [force[i][1] for i, _ in texts if i in force][:40], atol=1e-9)


def test_language_rejection(spark):
    """Other scripts, scrambled letters and noise go; nearly all texts of the tables stay, long and short."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs)
    rng = random.Random(3)
    foreign = ["漢字仮名交じり文は日本語の文です", "Привет как дела сегодня хорошо", "γειά σου κόσμε τι κάνεις", "qwrtpsdfg hjklzx cvbnm xqzj kwvpt"]
    foreign += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(120)) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string")
    assert all(r.rejected for r in langid.predict(rows, model).collect())
    got = langid.predict(docs, model).filter("lang_pred <> 'und'").collect()
    assert sum(r.rejected for r in got) <= 0.002 * len(got)
    assert langid.keep(docs.filter("text is not null")).count() >= 0.998 * len(got)


def test_language_trained_in_task(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    own = langid.train(*langid.sample(docs))
    monkeypatch.setattr(langid, "sample", lambda *_: pytest.fail("the sample came to the driver"))
    model = langid.fit(docs)
    assert model.langs == own.langs and np.array_equal(model.table, own.table)
    assert (model.temperature, model.threshold, model.support) == (own.temperature, own.threshold, own.support)
    assert langid.fit(docs.filter("false")) is None


def test_language_edges(docs, no_docs):
    got = langid.identify(docs).collect()
    assert len(got) == len(ROWS) and all(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 7))
    assert langid.identify(no_docs).count() == 0
    assert langid.keep(docs).columns == docs.columns


def test_token_files_against_library(spark, docs, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sources = [(r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect()]
    for df, texts in ((table(spark, SF, "documents"), sources), (docs.filter("doc_id is not null"), [x for x in TEXTS if x[0] is not None])):
        start, expected = 0, []
        for i, t in sorted(texts):
            ids = [*library.encode(t, add_special_tokens=False).ids, 2]
            expected.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            start += len(ids)
        found = tokenfiles.round_trip(df, queries.TOKEN_IDS).cache()
        assert rows_of(found.select("doc_id", "start", "n_tokens", "ids_crc32")) == sorted(expected, key=repr)
        assert found.schema["doc_id"].dataType.simpleString() == "bigint" and found.filter("last_id <> 2").count() == 0
    assert tokenfiles.round_trip(docs, queries.TOKEN_IDS).count() == len(ROWS)
    assert tokenfiles.round_trip(no_docs, queries.TOKEN_IDS).count() == 0


def test_codes_random_access():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = (2 ** rng.uniform(0, 31, n)).astype(np.uint32)
        codes = tokenfiles.Codes(tokenfiles.pack(ids))
        assert (codes.slice(0, n) == ids).all() and [codes[i] for i in range(n)] == ids.tolist()
        for a, b in rng.integers(0, n + 1, (30, 2)):
            assert (codes.slice(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()


def test_token_files_random_access(spark, docs, tmp_path):
    """Single ids, ranges and batches of places through the files, against the library."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.TOKEN_IDS)
    texts = {i: t or "" for i, t, _ in ROWS if i is not None}
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    for kind in ("long", "string"):
        path = f"file://{tmp_path}/{kind}"
        tokenfiles.write(docs.withColumn("doc_id", docs.doc_id.cast(kind)), queries.TOKEN_IDS, path, block=4096)
        assert spark.read.parquet(path).schema["codes"].dataType.simpleString() == "binary"
        for i in (1, 5, 9):
            for k in (0, len(ids[i]) // 2, len(ids[i]) - 1):
                assert tokenfiles.token_at(spark, path, i, k) == ids[i][k]
            assert tokenfiles.tokens(spark, path, i, 1, 7) == ids[i][1:7] and tokenfiles.tokens(spark, path, i, 10**6) == []
        with pytest.raises(IndexError):
            tokenfiles.token_at(spark, path, 1, 1)
        with pytest.raises(KeyError):
            tokenfiles.token_at(spark, path, 77, 0)
        asked = [(i, k) for i in texts for k in (-1, 0, 3, 3, 40_000, 10**7)] + [(77, 0), (None, 0), (1, None)]
        got = tokenfiles.tokens_at(spark.createDataFrame(asked, "doc_id long, i long"), path)
        expected = [(str(i), k, ids[i][k] if 0 <= k < len(ids[i]) else None) for i, k in asked[:-3] for _ in range(1 + (i == 3))]
        assert sorted(((str(r.doc_id), r.i, r.token) for r in got.collect()), key=repr) == sorted(expected, key=repr)


def test_decontamination_windows(monkeypatch):
    """Hits, items and longest matches against a search of every place, with the pairs that are chained at once bounded or not."""
    import random

    rng = random.Random(1)
    for _ in range(40):
        monkeypatch.setattr(decontam, "OWNERS", rng.choice([1, 50, 1 << 22]))
        monkeypatch.setattr(decontam, "SHARD", rng.choice([20, 1 << 20]))
        some = [f"w{i}" for i in range(rng.choice([2, 4, 30]))]
        pick = lambda n: [rng.choice(some) for _ in range(n)]
        items = [(i, " ".join(pick(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(rng.randint(1, 8))]
        items += [items[0], (99, None)]
        texts = [" ".join(pick(rng.randint(0, 30)) + (rng.choice(items)[1] or "").split() + pick(5)) for _ in range(6)] + [""]
        tests = decontam.Tests.of(items)
        if tests is None:
            assert not any(t for _, t in items)
            continue
        got = {k: (hits.tolist(), own, size) for k, hits, own, size in decontam.match([t.encode() for t in texts], tests)[1]}
        for k, text in enumerate(texts):
            w, hit, own, size = text.split(), set(), set(), 0
            for n, (_, item) in enumerate(items):
                v = (item or "").split()
                least = min(len(v), 10)
                for i, j in ((i, j) for i in range(len(w) - least + 1) for j in range(len(v) - least + 1) if v and w[i : i + least] == v[j : j + least]):
                    reach = least
                    while w[i + reach : i + reach + 1] == v[j + reach : j + reach + 1] != []:
                        reach += 1
                    hit, own, size = hit | set(range(i, i + least)), own | {n}, max(size, reach)
            assert got.get(k, ([], [], 0)) == (sorted(hit), sorted(own), size)


def test_decontamination_edges(spark, docs, no_docs):
    tests = spark.createDataFrame([("t1", "A b", 1), ("t2", None, 1), ("t3", "", 1), ("t1", "A b", 2)], "item_id string, text string, rank long")
    got = {r.doc_id: r for r in decontam.digests(docs, tests).collect()}
    assert got[3].n_hit == 2 and got[3].items_sha256 == hashlib.sha256(b"t1").hexdigest() and got[3].n_items == 1
    assert got[1].n_words == 0 and not got[1].contaminated and got[8].n_hit == 0
    assert decontam.digests(no_docs, tests).count() == 0
    assert decontam.digests(docs, tests.filter("false")).filter("contaminated").count() == 0
    assert {r.doc_id for r in decontam.clean(docs, tests).collect()} == {i for i, t in TEXTS if i not in (3, 4, 9)}  # 9 has "a.b", two words beside each other


def test_token_counts_against_library(spark, docs, no_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.TOKEN_COUNTS)
    for df in (docs, table(spark, SF, "documents")):
        texts = [(r.doc_id, r.text or "") for r in df.collect()]
        expected = sorted(((i, len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts), key=repr)
        assert rows_of(counts.count_tokens(df, queries.TOKEN_COUNTS).select("doc_id", "n_bytes", "n_tokens", "over_limit")) == expected
    assert counts.count_tokens(no_docs, queries.TOKEN_COUNTS).count() == 0


def test_token_counts_state_maps():
    """Texts whose chunks never meet the guessed trace, a table that has to grow, and the steps of the scan."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.TOKEN_COUNTS)
    machine = counts.CountingTransducer(counts.Vocabulary(queries.TOKEN_COUNTS))
    rng = random.Random(5)
    texts = ["a" * 10**6, "ab" * 50_000, " " * 30_001, "the" * 20_000, "0" * 9999, "".join(rng.choice("aet h") for _ in range(60_000)), "漢字😀" * 5000, "\n" * 700, "in" * 9999 + "g"]
    for text in texts:
        assert machine.count([text]).tolist() == [len(library.encode(text))]
        lanes = min(counts.LANES, max(1, (len(text) + 2) // 64))
        assert machine.steps == (lanes - 1).bit_length()
    assert machine.count(texts).tolist() == [len(library.encode(t)) for t in texts]
    machine.clear()
    machine._table(64)
    assert machine.count(texts[4:]).tolist() == [len(library.encode(t)) for t in texts[4:]] and len(machine.keys) > 64


def test_byte_bpe_against_library(spark, docs, no_docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BPE_RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, table(spark, SF, "documents")):
        expected = []
        for r in df.collect():
            ids = library.encode_ordinary(r.text or "")
            expected.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        got = rows_of(bpe.digests(df, queries.BPE_RANKS).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
        assert got == sorted(expected, key=repr)
    assert bpe.digests(no_docs, queries.BPE_RANKS).count() == 0


_BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_force(text: str) -> str:
    out = []
    for kind, pattern in _BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind == "card":
                luhn = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
                if not 16 <= len(digits) <= 19 or luhn % 10:
                    continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_against_patterns(spark, docs, no_docs):
    for df in (docs, table(spark, SF, "documents")):
        texts = sorted(((r.doc_id, hashlib.sha256(base_by_force(r.text or "").encode()).hexdigest()) for r in df.collect()), key=repr)
        got = pii.identify(df)
        assert rows_of(got.select("doc_id", "base_sha256")) == texts
        for r in got.collect():
            assert len([s for s in r.spans.split(",") if s]) >= r.n_email + r.n_ip + r.n_card + r.n_phone
    assert pii.identify(no_docs).count() == 0


def test_pii_skip_links(spark):
    """A later mention of a number without its sign is found through the first."""
    texts = [f"call +4930 {1000000 + i} now. Again: 4930 {1000000 + i} ok" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.identify(df).collect()
    assert all(r.n_phone == 1 for r in found) and sum(r.spans.count("phone") == 2 for r in found) >= 36


def test_pii_many_repeats():
    """Each of fifty bare repeats is found, before the base span and after it; repeats of another number are not."""
    bare, other = "then 4930 1234567 it is. " * 50, "part 555 0001 222 here. " * 50
    for text in (f"call +4930 1234567 now. {bare}{other}", f"{other}{bare}call +4930 1234567 now."):
        model = pii.Field.learn([text])
        base, every = pii.spans(text, model)
        assert len(base["phone"]) == 1 and len(every["phone"]) == 51
        assert all(text[a:b].endswith("4930 1234567") for a, b in every["phone"]) and sum(map(len, every.values())) == 51


def test_neighbours_full_answers(spark):
    """A query whose probed parts hold too few rows goes on to further parts, and to all where ids repeat."""
    rng = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 8)))]
    narrow = ann.Settings(part_rows=4, recall=0.0)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(vectors, vectors, settings=narrow).groupBy("query_id").count().collect()
    assert len(found) == 60 and all(r["count"] == 5 for r in found)
    rows += [(7, x.tolist()) for x in rng.normal(size=(60, 8)) * 0.01 + rows[0][1]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(vectors, vectors, settings=narrow).collect()
    assert len(found) == 300 and len({(r.query_id, r.vec_id) for r in found}) == 300
    best = max(ann.cosines(np.array(rows[0][1]), np.array([x for i, x in rows if i == 7])))
    assert next(r.score for r in found if (r.query_id, r.vec_id) == (0, 7)) == best
    everything = ann.search(vectors, vectors, k=100).groupBy("query_id").count().collect()
    assert all(r["count"] == 59 for r in everything)


def test_neighbours_prune(spark):
    """Fifty thousand vectors in many parts: recall against brute force, exact scores and order, and few rows scanned."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 32))[rng.integers(0, 500, 50_000)] + 0.3 * rng.normal(size=(50_000, 32))
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    index = ann.build(vectors)
    asked = vectors.filter("vec_id % 50 = 0")
    routes = index.route(asked).cache()
    assert len(index.sizes) >= 10 and index.scanned(routes) < 0.25
    found = defaultdict(list)
    for r in index.rank(routes).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 50_000, 50):
        s = (x @ x[q]) / np.sqrt((x * x).sum(1) * (x[q] @ x[q]))
        s[q] = -2
        hits += len({i for i, _ in found[q]} & set(np.argpartition(-s, 5)[:5].tolist()))
        assert len(found[q]) == 5 and all(abs(s[i] - v) < 1e-12 for i, v in found[q])
        assert found[q] == sorted(found[q], key=lambda r: (-r[1], r[0]))
    assert hits >= 0.9 * 5000


def test_neighbours_far_scales(spark):
    """Components far from one neither overflow nor vanish; equal vectors tie to the smaller id."""
    rows = [(0, [1e200, 2e200]), (1, [1e-200, 2e-200]), (2, [2e-200, 1e-200]), (3, [1.0, 2.0]), (4, [1e200, 2e200])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(vectors, vectors.filter("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 3, 4, 2] and abs(got[0].score - 1) < 1e-15 and abs(got[3].score - 0.8) < 1e-15
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    got = ann.search(same, same.filter("vec_id = 3")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 4, 5]


def test_pii_without_base_span():
    """The field decides also where no base span stands; a learned one gives repeats of a rare shape no label."""
    text = "ask 4930 1234567 or again 4930 1234567 there"
    sure = pii.Field(unary={"number11": np.log([0.1, 0.1, 0.1, 0.1, 0.6])})
    assert [len(x["phone"]) for x in pii.spans(text, sure)] == [0, 2]
    learned = pii.Field.learn(["call +4930 1234567 now, not 4930 7654321", "part 555 0001 222"] * 20)
    assert not any(pii.spans("part 555 0001 222 here. " * 30, learned)[1].values())
    assert not any(pii.spans(text, learned)[1].values())


def marginals_by_force(model: pii.Field, nodes: list, edges: list) -> np.ndarray:
    """Marginals by adding up all labellings."""
    from itertools import product

    out = np.zeros((len(nodes), 5))
    for labels in product(range(5), repeat=len(nodes)):
        if all(not x[4] or x[4] == y for x, y in zip(nodes, labels)):
            w = sum(0 if x[4] else (model.common + model.unary.get(x[2], 0))[y] for x, y in zip(nodes, labels))
            w += sum(model.chain[labels[k], labels[k + 1]] for k in range(len(nodes) - 1)) + sum(model.skip[kind][labels[a], labels[b]] for a, b, kind in edges)
            out[range(len(nodes)), labels] += np.exp(w)
    return out / out.sum(1, keepdims=True)


def test_pii_marginals():
    """Message passing is exact on chains, and near to it where skip edges close loops; observed nodes keep their labels."""
    rng = np.random.default_rng(6)
    for _ in range(5):
        skip = rng.normal(0, 0.7, (2, 5, 5))
        model = pii.Field(rng.normal(0, 1, 5), {"s": rng.normal(0, 1, 5)}, rng.normal(0, 0.5, (5, 5)), skip + skip.transpose(0, 2, 1))
        nodes = [(k, k + 1, "s" if k % 2 else "t", ([], []), 3 if k == 2 else 0) for k in range(5)]
        assert np.allclose(model.infer(nodes, []), marginals_by_force(model, nodes, []), atol=2e-3)
        edges = [(0, 2, 0), (2, 4, 1), (0, 4, 0)]
        got, force = model.infer(nodes, edges), marginals_by_force(model, nodes, edges)
        assert np.abs(got - force).max() < 0.2 and got[2, 3] == force[2, 3] == 1


def test_pii_learning():
    """The learned potentials give a planted repeat its kind, and similar forms too; other numbers of that shape stay other."""
    texts = [f"call +49301234{i:03d} or id 4930888{i:04d} and j.smith{i}@mail.com. ref 12345{i:04d}" for i in range(100)]
    model = pii.Field.learn(texts)
    assert all(np.allclose(s, s.T) for s in model.skip) and model.skip[0][4, 4] > model.skip[0][0, 4]
    base, every = pii.spans("call +49301234555 x 49301234555 y 01234555 z 4930777777 and ann.lee7@mail.com, ann_lee wrote", model)
    assert [len(x["phone"]) for x in (base, every)] == [1, 3] and [len(x["email"]) for x in (base, every)] == [1, 2]
    more = pii.Field.learn(texts, rounds=400)
    assert all(pii.spans(t, more) == pii.spans(t, model) for t in texts)


def test_pii_counts_and_redaction(spark, docs):
    """Counts of each kind against the patterns; redacted texts, also long ones, hold no base span any more."""
    model = pii.learn(docs)
    texts = dict(TEXTS)
    for r in pii.find(docs, model).collect():
        if r.doc_id is not None:
            force = [x.split(":")[0] for x in base_by_force(texts[r.doc_id]).split(",") if x]
            assert [r[f"n_{k}"] for k in pii.KINDS] == [force.count(k) for k in pii.KINDS]
    rows = [(1, None), (2, ""), (3, "a b@c.de, 4111 1111 1111 1111"), (4, "+49 30 1234567 " + "lorem ipsum " * 20_000 + "x.y@z.org"), (5, "a+1.2.3.4@b.cc")]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] is None and got[2] == "" and got[3] == "a [email], [card]" and got[5] == "[email]"
    assert got[4].startswith("[phone] lorem") and got[4].endswith("ipsum [email]") and len(got[4]) == 15 + 240_000
