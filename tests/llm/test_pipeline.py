"""The pipeline against plain versions of its stages, one after another."""

import random
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.data import near_copies, words
from tests.llm.test_brute_force import WORD, components, plain_chunks

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def quality(text):
    w = WORD.findall(text)
    n, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if n[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return not (len(w) < 50 or 100 * len(covered) > 50 * len(w) or 10 * symbols > len(w) or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or sum(map(len, w)) < 2 * len(w))


def hit(text, items):
    w = ITEM.findall(text.lower())
    spans = {k: {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} for k in range(1, 11)}
    for t in items:
        v = ITEM.findall(t.lower())
        k = min(len(v), 10)
        if k and any(tuple(v[j : j + k]) in spans[k] for j in range(len(v) - k + 1)):
            return True
    return False


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(11)
    items = [" ".join(words(rng, 25, 9000)) for _ in range(4)]
    passage = "\n".join(" ".join(words(rng, 20, 9000)) for _ in range(3)) + "\n" + " ".join(words(rng, 60, 9000))
    rows = [(d, t) for d, t in near_copies(4, families=6, members=6, single=10)]
    for i in range(1000, 1060):
        own = [f"u{rng.randrange(9000)}" for _ in range(rng.randrange(60, 150))]
        text = " ".join(own[: len(own) // 2]) + "\n" + " ".join(own[len(own) // 2 :])
        text += "\n" + passage if i % 4 == 0 else "\n" + rng.choice(items) if i % 7 == 0 else " #$%" * 30 if i % 11 == 0 else ""
        rows.append((i, text))
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = [(d, t) for d, t in rows if quality(t)]
    steps = [dict(want)]
    cut = {d: t for d, t in plain_chunks(want).items() if WORD.search(t)}
    steps.append(cut)
    near = components(list(cut.items()))
    steps.append({d: t for d, t in cut.items() if near[d][1] == d})
    steps.append({d: t for d, t in steps[-1].items() if not hit(t, items)})
    assert [len(rows), *map(len, steps)] == sorted([len(rows), *map(len, steps)], reverse=True) and len(steps[0]) > len(steps[1]) > len(steps[2]) > len(steps[3]) and any(cut.get(d) not in (t, None) for d, t in want)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = {r.doc_id: r for r in docs.collect()}
        assert {d: r.text for d, r in got.items()} == steps[k], name
        assert all(r.n_chars == len(r.text) for r in got.values())
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for pieces in (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        total = Counter()
        for r in pieces.collect():
            total[r.doc_id] += r.length
        assert total == {d: len(whole.encode(t, add_special_tokens=False).ids) + 1 for d, t in steps[-1].items()}


def test_each_task_needs_one_worker(spark, tmp_path, monkeypatch):
    """Line dedup runs its function of texts once, and packing sends its plan without a pool of workers of its own: workers are kept,
    and hold memory in all later stages."""
    rows = [(d, f"{t}\n{t}", "en", "s", 2 * len(t) + 1) for d, t in near_copies(5, families=2, members=3, single=2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plan = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1

    def refuse(*_, **__):
        raise AssertionError("rows of Python are sent through workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path)).count() >= len(rows)
