import hashlib

from brute import removed, similar_classes, word_list
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import pii, quality
from ledgerloom.storage import written
from test_operators import by_key, check_packing


def test_each_stage_against_brute_force(spark, docs):
    docs = written(docs.select("doc_id", "text", "lang", "source", "n_chars"), "input")
    outputs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        outputs.append(written(stage(spark, outputs[-1], ""), "output"))
    docs, kept, single, cut, clean, packed = outputs
    columns = docs.columns
    assert all(x.columns == columns for x in outputs[1:-1])

    verdict = quality.quality_report(docs).filter("kept")
    assert by_key(kept.select("doc_id").collect()) == by_key(verdict.select("doc_id").collect())

    want = similar_classes([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert sorted((r["doc_id"] for r in single.collect()), key=str) == sorted(want, key=str)

    before = [(r["doc_id"], r["text"]) for r in single.collect()]
    plain = lambda t: hashlib.sha256(" ".join(word_list(t)).encode()).hexdigest()
    after = [(r["doc_id"], r["text"]) for r in cut.collect()]
    assert by_key((i, plain(t)) for i, t in after) == by_key((i, sha) for i, _, _, sha in removed(before))
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    whole = [x for x, (_, _, n, _) in zip(sorted(before, key=str), removed(before)) if n == 0 and x[0] < 300]
    assert set(whole) <= set(after)

    for a, b in zip(sorted(cut.collect(), key=str), sorted(clean.collect(), key=str)):
        if not list(pii.mentions(a["text"])):
            assert a == b

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [[*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2] for r in clean.collect()]
    check_packing(packed.toPandas(), ids)
