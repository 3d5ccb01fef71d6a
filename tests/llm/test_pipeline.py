"""Stages of the corpus pipeline, each on its own input against a brute-force version."""

import base64
import hashlib
import re
import struct

import public_tokenizers
import pytest

import corpus_pipeline as pipeline
from crawlframe.llm import langid
from crawlframe.llm.common import table
from crawlframe.llm.queries import BPE_RANKS
from tests.llm.test_operators import clusters_by_force, language_by_force, removed_by_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) rows of each stage, as written and read again."""
    docs, found = table(spark, SF, "documents"), {}
    planted = [(900_000 + k, t, None, "planted", 0) for k, t in enumerate([None, "", "12 34 !", "漢字仮名交じり文は日本語の文です", "Привет как дела сегодня хорошо", "qwrtpsdfg hjklzx cvbnm xqzj kwvpt"])]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        found[name] = (docs.collect(), out.collect())
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == pipeline.COLUMNS and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        docs = out
    return found


def texts(rows) -> list[tuple[int, str]]:
    return sorted((r.doc_id, r.text or "") for r in rows)


def test_language_id(spark, stages):
    before, after = stages["language_id"]
    model = langid.fit(table(spark, SF, "documents"))
    stay = set()
    for i, t in texts(before):
        if any(map(str.isalpha, t)):
            shares = model.means([t])[0, -1]
            if language_by_force(t, model)[1] >= model.threshold and shares >= model.support:
                stay.add((i, t))
    assert set(texts(after)) == stay and 0.9 * len(before) < len(stay) <= len(before) - 6 and all(i < 900_000 for i, _ in stay)


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    force = {}
    for i, lines in removed_by_force(texts(before), 50).items():
        if lines:
            force[i] = "\n".join(lines)
    assert dict(texts(after)) == force and len(force) < len(before)
    chars = {r.doc_id: (r.text, r.n_chars) for r in before}
    for r in after:
        assert r.n_chars == (chars[r.doc_id][1] if r.text == chars[r.doc_id][0] else len(r.text))


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    stay = {i for i, _, _, first in clusters_by_force(texts(before), 5, 80) if first}
    assert texts(after) == [x for x in texts(before) if x[0] in stay] and len(stay) < len(before)


def words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_decontamination(spark, stages):
    before, after = stages["benchmark_decontamination"]
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r.text or "")
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} - {()}
    stay = []
    for i, t in texts(before):
        w = words(t)
        if not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1)):
            stay.append((i, t))
    assert texts(after) == stay and len(stay) < len(before)


def test_bpe_encoding(stages):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE_RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = stages["bpe_encoding"]
    force = []
    for i, t in texts(before):
        ids = library.encode_ordinary(t)
        force.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == force


def test_run(spark, stages):
    assert sorted(r.doc_id for r in pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in stages["bpe_encoding"][1])


def test_edges(spark, docs, no_docs):
    for df in (docs, no_docs):
        for name, stage in pipeline.STAGES:
            stage(spark, df, SF).count()
