"""The corpus pipeline, stage by stage against plainer versions, and as a whole."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from docgrid.llm import common, linededup, minhash, pii, toxicity
from docgrid.llm.common import saved


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, rows = docs, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, saved(stage(spark, kept, sf), "stage")
        old, rows = rows, {r.doc_id: r for r in kept.collect()}
        assert kept.columns == docs.columns and rows.keys() <= old.keys(), name
        if name == "toxicity":
            score = {r.doc_id: r.score for r in toxicity.toxic_documents(before, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
            assert rows.keys() == {i for i, s in score.items() if s < toxicity.THRESHOLD} and all(rows[i] == old[i] for i in rows)
        if name == "line_dedup":
            first = set()
            for i in sorted(old):  # of equal lines the first one stays, near ones may go too
                lines = [x for x in (old[i].text or "").split("\n")]
                left = (rows[i].text or "").split("\n") if i in rows else []
                assert set(left) <= set(lines)
                for x in lines:
                    if linededup.normalised(x) in first and lines.count(x) == 1:
                        assert x not in left
                first |= {linededup.normalised(x) for x in lines} - {""}
            assert linededup.repeated_lines(kept).where("not kept").count() <= 0.01 * linededup.repeated_lines(kept).count()
        if name == "minhash_dedup":
            assert all(rows[i] == old[i] for i in rows)
            assert rows.keys() == {r.doc_id for r in minhash.near_duplicates(before).where("kept").collect()}
            assert minhash.near_duplicates(kept).where("not kept").count() == 0
        if name == "pii":
            ids = sorted(old)
            found = pii.found_spans([old[i].text or "" for i in ids], whole=True)
            assert {i: rows[i].text or "" for i in ids} == {i: pii.masked(old[i].text or "", every) for i, (_, every) in zip(ids, found)}
    assert len(rows) > 0.6 * docs.count()
    before = set(common._written)
    pieces = corpus_pipeline.run(spark, sf)
    assert sorted(p.rsplit("/", 1)[-1].split("-")[1] for p in set(common._written) - before) == sorted(name for name, _ in corpus_pipeline.STAGES[:-1])  # nothing else is left behind
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, sequences = {}, {}
    for p in pieces.collect():
        got.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    assert got.keys() == rows.keys()
    for i, own in got.items():
        ids = np.array([*tool.encode(rows[i].text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert all(sum(p.length for p in own) <= 1024 for own in sequences.values())
