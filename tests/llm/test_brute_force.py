"""Operators against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ohmtide.llm import chunks, countjoin, decontam, encoding, ledger, lookup, mixing, packing, tokencount
from ohmtide.llm.common import scratch_path
from tests.llm.data import near_copies, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def components(rows, size=5):
    sets = {}
    for d, t in rows:
        w = WORD.findall(t.lower())
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset()
    best = {d: d for d in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    return {d: (len(sets[d]), best[d]) for d in sets}


def test_similarity_join_in_one_tile_and_in_many(spark):
    rows = near_copies()
    want = components(rows)
    assert len({c for _, c in want.values()}) < len(want) - 20
    for options in ({}, {"block_sets": 3, "group_shingles": 150}):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in countjoin.similar(frame(spark, rows), **options).collect()}
        assert got == want


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    base = rng.poisson(4, (30, 64))
    vectors = np.maximum(np.repeat(base, 10, axis=0) + rng.integers(-1, 2, (300, 64)), 0)
    sizes = vectors.sum(axis=1)
    tree = countjoin.CountTree(vectors, sizes)
    for i in range(0, 300, 7):
        want = np.flatnonzero(np.minimum(vectors, vectors[i]).sum(axis=1) >= countjoin.needed(sizes, sizes[i]))
        assert set(want) == set(tree.search(vectors[i], sizes[i]))


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, n, 30))) for i, n in enumerate([25, 12, 10, 9, 4, 2, 1, 30, 30])] + [(50, "Größe-20 IST, wie viel?")]
    docs = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 80), 40)
        if i % 3 == 0:
            own = items[rng.randrange(len(items))][1].split()
            at = rng.randrange(len(w) + 1)
            w = w[:at] + own[rng.randrange(3) :][: rng.randrange(9, 40)] + w[at:]
        docs.append((i, ("; " if i % 2 else " ").join(w).upper()))
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontam.find(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in docs:
        w, hit, ids = split.findall(t.translate(lower)), set(), set()
        for i, text in items:
            v = split.findall(text.translate(lower))
            for k in {tuple(v[j : j + 10]) for j in range(max(len(v) - 9, 1))}:
                for a in range(len(w) - len(k) + 1):
                    if tuple(w[a : a + len(k)]) == k:
                        hit |= set(range(a, a + len(k)))
                        ids.add(str(i))
        assert got[d] == (len(w), len(hit), sorted(ids)), d


def plain_chunks(rows):
    """Texts without runs of repeated chunks, by lists and dictionaries of strings."""
    cut, places = {}, {}
    for d, t in rows:
        lines, own, part, before = t.split("\n"), [], [], 0
        sizes = [len(WORD.findall(x)) for x in lines] + [8]
        for i, line in enumerate(lines):
            part.append((i, line, sizes[i]))
            h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
            if sizes[i] >= 8 or sizes[i + 1] >= 8:
                ends, before = True, 0
            else:
                ends, before = ((31 * before + 17 * h) % 2**32 // 128) % 2 == 0, h
            if ends:
                own.append(part)
                part = []
        cut[d] = [(p[0][0], "\n".join(x for _, x, _ in p), sum(n for _, _, n in p)) for p in [*own, part] if p]
        for k, (at, text, n) in enumerate(cut[d]):
            for unit in [(text,)] * (n >= 40) + [(text, x) for _, x, _ in cut[d][k + 1 : k + 2]]:
                places.setdefault(unit, []).append((d, at, k))
    marked = {(d, k + j) for unit, found in places.items() for d, at, k in found if (d, at, k) != min(found) for j in range(len(unit))}
    out = {}
    for d, own in cut.items():
        kept = []
        for gone, run in itertools.groupby(enumerate(own), lambda x: (d, x[0]) in marked):
            run = [c for _, c in run]
            if not gone or sum(n for _, _, n in run) < 40:
                kept += [text for _, text, _ in run]
        out[d] = "\n".join(kept)
    return out


def test_line_chunks_also_where_digests_collide(spark, monkeypatch):
    from ohmtide.llm import common

    rng = random.Random(5)
    shared = ["\n".join(" ".join(words(rng, 8)) for _ in range(9)), " ".join(words(rng, 60)), "a b\n\nc d", "\n".join(" ".join(words(rng, 3)) for _ in range(30))]
    rows = []
    for i in range(50):
        own = [" ".join(words(rng, rng.randrange(0, 12))) for _ in range(rng.randrange(1, 12))]
        for s in shared:
            if rng.random() < 0.4:
                own.insert(rng.randrange(len(own) + 1), s)
        rows.append((i, "\n".join(own)))
    want = plain_chunks(rows)
    assert sum(len(want[d]) < len(t) for d, t in rows) > 20
    for key, bound in ((chunks.digest, 200_000), (lambda unit: chunks.digest(unit)[:1], 200_000), (chunks.digest, 0)):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        got = {r.doc_id: r.text for r in chunks.dedup_lines(frame(spark, rows), key).collect()}
        assert got == want


def test_planted_passages_go_and_other_lines_stay(spark):
    """Passages of 50 words and more in lines of several lengths, each in some of 60 documents of other lines: the share of the words of
    later occurrences that go."""
    for lines, size, least in ((2, 26, 1.0), (3, 20, 1.0), (5, 12, 1.0), (7, 8, 1.0), (1, 55, 1.0), (20, 5, 0.75)):
        rng = random.Random(lines)
        fresh = iter(range(10**7))
        passages = [[" ".join(f"p{next(fresh)}" for _ in range(size)) for _ in range(lines)] for _ in range(8)]
        rows, later, first = [], 0, set()
        for i in range(60):
            own = [[" ".join(f"x{next(fresh)}" for _ in range(rng.randrange(1, 30)))] for _ in range(6)]
            for k in rng.sample(range(8), 2):
                own.insert(rng.randrange(len(own) + 1), passages[k])
                later += lines * size if k in first else 0
                first.add(k)
            rows.append((i, "\n".join(x for part in own for x in part)))
        got = {r.doc_id: r.text for r in chunks.dedup_lines(frame(spark, rows)).collect()}
        gone = sum(len(t.split()) - len(got[d].split()) for d, t in rows)
        assert least * later <= gone <= later
        assert all([w for w in t.split() if w[0] == "x"] == [w for w in got[d].split() if w[0] == "x"] for d, t in rows)


def test_ledger_and_ablations(spark):
    rng = random.Random(7)
    rows = []
    for i in range(80):
        w = words(rng, rng.randrange(0, 130), 30 if i % 2 else 3000)
        if i % 5 == 0:
            w = [x + "#$" for x in w]
        text = " ".join(w)
        rows.append((i, (text[: len(text) // 2] + "\n" + "dup\n" * rng.choice([0, 0, 8]) + text[len(text) // 2 :])))
    found = ledger.evaluate(frame(spark, rows))
    got = {r.doc_id: r for r in found.collect()}
    for d, t in rows:
        w = WORD.findall(t)
        n, c = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if n[tuple(w[i : i + 3])] > 1:
                c |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (got[d].n_words, got[d].n_repeat_words, got[d].word_chars, got[d].n_dup_lines) == (len(w), len(c), sum(map(len, w)), len(lines) - len(set(lines)))
        assert got[d].n_symbols == len(re.findall(r"[#*$%&|<>]", t))
    mask = ledger.mask("web-1")
    for r in ledger.ablations(found, "web-1").collect():
        b = ledger.bit(r.rule)
        bits = [x.failure_bits for x in got.values()]
        assert r.n_failed == sum(bool(x & b) for x in bits) and r.n_only == sum(x & mask == b for x in bits) and r.n_kept_without == sum(x & mask & ~b == 0 for x in bits)
    stored = ledger.store(frame(spark, rows), scratch_path(spark, "ledger"))
    assert {r.doc_id: r.failure_bits for r in stored.collect()} == {d: r.failure_bits for d, r in got.items()}
    bits = [x.failure_bits & mask for x in got.values()]
    rule = {ledger.bit(r): r for r in ledger.POLICIES["web-1"]}
    for r in ledger.with_ablations(stored, "web-1").collect():
        b = r.failure_bits & mask
        counts = (rule[b], bits.count(b), bits.count(0) + bits.count(b)) if b in rule else (None, None, None)
        assert (r.kept, r.only_rule, r.n_only, r.n_kept_without) == (b == 0, *counts)


def test_lookup_table():
    shards, slots = [f"s{i}" for i in range(7)], 101
    got = lookup.lookup_table(shards, slots)
    want, nxt = {}, [0] * 7
    order = []
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        order.append([(a + j * b) % slots for j in range(slots)])
    while len(want) < slots:
        for i in range(7):
            if len(want) == slots:
                break
            while order[i][nxt[i]] in want:
                nxt[i] += 1
            want[order[i][nxt[i]]] = i
    assert [want[j] for j in range(slots)] == got.tolist()
    counts = np.bincount(got)
    assert counts.max() - counts.min() <= 1
    big = lookup.lookup_table([f"s{i}" for i in range(50)], 10_007)
    less = lookup.lookup_table([f"s{i}" for i in range(49)], 10_007)
    assert (big[big != 49] == less[big != 49]).mean() > 0.9


def test_keys_are_placed_by_one_look_into_the_table(spark):
    shards = [f"s{i}" for i in range(7)]
    table = lookup.lookup_table(shards, 101)
    keys = [*range(300), 5, 5, None, None]
    placed = lookup.place(spark.createDataFrame([(k,) for k in keys], "doc_id bigint"), "doc_id", shards, 101).collect()
    want = []
    for k in keys:
        slot = int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16) % 101
        want.append((k, slot, int(table[slot]), shards[table[slot]]))
    assert sorted(map(tuple, placed), key=str) == sorted(want, key=str)
    assert lookup.place(spark.createDataFrame([], "doc_id bigint"), "doc_id", shards, 101).count() == 0


def test_plans_use_all_pieces_and_few_sequences():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 3000):
        lengths = np.minimum(rng.lognormal(5, 1.3, n).astype(int) + 1, 2048)
        counts = np.bincount(lengths, minlength=2049)
        plans = packing.plan(counts)
        used = Counter()
        for x, times in plans:
            assert sum(x) <= 2048
            for y in x:
                used[y] += times
        assert used == Counter(lengths.tolist())
        assert sum(t for _, t in plans) <= -(-int(lengths.sum()) // 2048) + 1


def test_packing_round_trip(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, rng.choice([0, 1, 5, 40, 300])))) for i in range(60)]
    got = packing.pack(frame(spark, rows), PATH, 128).toPandas()
    whole = Tokenizer.from_file(PATH)
    import zlib

    for d, t in rows:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        own = got[got.doc_id == d].sort_values("piece")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids)
        assert (own.length.iloc[1:] == 128).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(own.start, own.length)]
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 128
    room = []
    for n in sorted(got.length, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 128) - n)
    assert got.sequence_id.nunique() <= len(room)


def test_token_counts_and_their_cache(spark, monkeypatch):
    rows = [(1, "a b c"), (2, "a b c"), (3, "<|endoftext|> é"), (4, None), (5, "日本 x"), (6, "")]
    cache = scratch_path(spark, "cache")
    first = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(frame(spark, rows), cache, PATH).collect()}
    whole = Tokenizer.from_file(PATH)
    assert first == {d: len(whole.encode(t or "", add_special_tokens=False).ids) for d, t in rows}
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    tokencount.count_tokens(frame(spark, [*rows, (9, "new text")]), cache, PATH).collect()
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows}) + 1
    assert spark.read.parquet(cache).groupBy("text_digest").count().where("count > 1").count() == 0
    other = tokencount.count_tokens(frame(spark, rows), cache, public_tokenizers.path("piece_bpe_32k.model"))
    assert other.count() == len(rows)


def test_both_encoders_give_the_same_ids():
    own = encoding.Encoder(PATH)
    assert own.fast is not None
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x250)]
    texts = ["".join(a + b + c for a, b, c in zip(letters, letters[k:], letters[2 * k :])) for k in range(1, 200, 7)]
    texts += ["".join(rng.choice(letters if rng.random() < 0.3 else " \n\tab'sXé1") for _ in range(300)) for _ in range(300)]
    texts += ["<|endoftext|>", "x<|endoftext|>y", "日本 Ω", "a" * 5000, " " * 3000]
    assert own.encode(texts) == own.slow(texts)


def test_scores(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join(vocabulary[min(int(rng.paretovariate(1)) - 1, 299)] for _ in range(rng.randrange(0, 200)))) for i in range(150)]
    rows += [(1000, None), (1001, "UPPER upper Upper"), (1002, "never seen words at all")]
    got = {r.doc_id: r for r in mixing.score(frame(spark, rows)).collect()}
    import zlib

    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {d: [*WORD.findall((t or "").translate(lower)), None] for d, t in rows}
    c = Counter(x for d, t in toks.items() if not held[d] for x in t)
    n, v = sum(c.values()), len(c)
    for d, t in toks.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(t), sum(c[x] > 0 for x in t), n)
        assert abs(r.base_score - sum(np.log10((c[x] + 1) / (n + v + 1)) for x in t)) < 1e-6
        assert r.score < 0 and np.isfinite(r.score)
    # What a held-out text says can't change what others score.
    other = [(d, "quite different" if held[d] and d == next(x for x in held if held[x]) else t) for d, t in rows]
    again = {r.doc_id: r.score for r in mixing.score(frame(spark, other)).collect()}
    changed = next(x for x in held if held[x])
    assert all(abs(again[d] - got[d].score) < 1e-9 for d in again if d != changed)


def test_choices_of_a_next_token_sum_to_at_most_one():
    """Of all words that could follow a text, with one for all unknown words."""
    words_ = [f"a{i}" for i in range(6)]
    hashes = {w: int(mixing.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in [*words_, "zz"]}
    counts = dict(zip(words_, [50, 20, 10, 5, 2, 1])) | {"end": 4}
    total, distinct = sum(counts.values()), len(counts)
    rng = random.Random(8)
    for n in (0, 1, 3, 12):
        text = [rng.choice(words_) for _ in range(n)]
        p = 0.0
        for w in [*words_, "zz", "end"]:
            seq = [*text, w]
            arr = np.array([hashes[x] if x != "end" else int(mixing.END) for x in seq], np.uint64)
            c = np.array([counts.get(x, 0) for x in seq])
            p += float(np.exp(mixing.Model(total, distinct).score(arr, np.array([0, len(seq)]), c, np.array([False]))[-1]))
        assert 0.5 < p <= 1 + 1e-9, (n, p)


def test_scores_learn_from_all_training_texts_however_the_input_is_cut(spark):
    """Small lots, more files and another order of rows give the scores of one lot."""
    rng = random.Random(16)
    rows = [(i, " ".join(f"v{min(int(rng.paretovariate(1)), 200)}" for _ in range(rng.randrange(5, 80)))) for i in range(300)]
    rows = [(i, f"{t} {t}" if i % 3 else t) for i, t in rows]
    whole = {r.doc_id: r for r in mixing.score(frame(spark, rows).coalesce(1)).collect()}
    cut = {r.doc_id: r.score for r in mixing.score(frame(spark, rows[::-1]).repartition(5, "doc_id"), lot_bytes=2000).collect()}
    assert all(abs(whole[d].score - cut[d]) < 1e-6 for d in whole)
    held = [r for r in whole.values() if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_predict_new_words_from_the_words_before(spark):
    """No word comes twice in a text: only other texts say what follows it. The same words in another order score less."""
    rng = random.Random(26)
    follows = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(follows[k : k + 30])) for i in range(400) for k in [rng.randrange(370)]]
    held = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 == 2]
    texts = dict(rows)
    plain = {r.doc_id: r for r in mixing.score(frame(spark, rows)).collect()}
    mixed = {r.doc_id: r for r in mixing.score(frame(spark, [(d, " ".join(rng.sample(t.split(), 30)) if d in held else t) for d, t in rows])).collect()}
    assert len(held) > 20 and all(len(set(texts[d].split())) == 30 for d in held)
    for d in held:
        assert abs(plain[d].base_score - mixed[d].base_score) < 1e-6
        assert plain[d].score > mixed[d].score
    assert sum(plain[d].score for d in held) > 0.4 * sum(mixed[d].score for d in held)


def test_a_model_that_has_learnt_gives_all_next_tokens_a_probability_of_one():
    """Frequent words, words of buckets, the end and the unknown word, after learning; counts are those of a plain loop over bits."""
    rng = random.Random(27)
    names = [f"n{i}" for i in range(40)]
    hashes = [int(mixing.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in names] + [int(mixing.END)]
    texts = [[*(min(int(rng.paretovariate(0.8)) - 1, 38) for _ in range(rng.randrange(1, 30))), 40] for _ in range(200)]
    c = np.bincount([x for t in texts for x in t], minlength=41)
    frequent = c >= 20
    buckets = np.zeros(1 << mixing.BUCKET_BITS)
    for h, n in zip(hashes, c):
        buckets[h >> (64 - mixing.BUCKET_BITS)] += (n + 1) * (0 < n < 20)
    tree = mixing.Tree(np.array(hashes, np.uint64)[frequent], c[frequent], buckets, 0)
    assert abs(sum(0.5 ** int(n) for n in tree.length) - 1) < 1e-12
    model = mixing.Model(int(c.sum()), int((c > 0).sum()), tree).ready("count")

    def run(texts, task, learn):
        flat, begin = [x for t in texts for x in t], np.cumsum([0, *map(len, texts)])
        return model.score(np.array(hashes, np.uint64)[flat], begin, c[flat], np.full(len(texts), learn), task)

    run(texts, "count", True)
    ways = Counter()
    for t in texts:
        for leaf in tree.leaves(np.array(hashes, np.uint64)[t], c[t]):
            ways.update(tree.path[tree.start[leaf] : tree.start[leaf] + tree.length[leaf]].tolist())
    assert {k: int(v) for k, v in enumerate(model.zero) if v} == dict(ways)
    assert model.one.sum() == model.two.sum() == sum(ways.values())
    model.take(dict(model.sums("count")))
    run(texts, "fit", True)
    model.take({})
    unknown = 39
    assert c[unknown] == 0
    for n in (0, 1, 5, 40):
        text = [rng.randrange(39) for _ in range(n)]
        following = [k for k in range(41) if c[k] > 0] + [unknown]
        logs = [run([[*text, k]], "score", False)[-1] for k in following]
        assert abs(np.exp(logs).sum() - 1) < 1e-4, n


def test_places_of_equal_keys_are_counted_as_a_plain_loop_does():
    """Zeros and ones of a key before each place, numbers of its run, and orders found by sorting keys with their places."""
    rng = np.random.default_rng(28)
    for n in (0, 1, 2, 700):
        key, bit = rng.integers(0, 60, n), rng.integers(0, 2, n).astype(np.uint8)
        runs, seen, want = mixing.Runs(key, bit), Counter(), []
        for k, b in zip(key.tolist(), bit.tolist()):
            want.append((seen[k, 0], seen[k, 1], sum(key == k), sum(bit[key == k])))
            seen[k, b] += 1
        assert runs.spread(runs.size, runs.ones).tolist() == [[float(v) for v in r] for r in want]
        assert mixing.in_order(key).tolist() == np.argsort(key, kind="stable").tolist()
        wide = key.astype(np.uint64) << np.uint64(40)
        assert mixing.repeated(wide).tolist() == [sum(key == k) > 1 for k in key]


def test_only_places_of_shared_keys_are_counted_and_ways_are_compared_as_numbers():
    """Against plain loops: counts of keys that come more than once, common bits of two ways, slots of threes, and halved counts."""
    rng = np.random.default_rng(29)
    for n in (0, 1, 2, 500):
        key, bit = rng.integers(0, 200, n), rng.integers(0, 2, n)
        at, before, whole, keys = mixing.Runs(key, bit).shared()
        want, pair = {}, lambda mask: (int((mask & (bit == 0)).sum()), int((mask & (bit == 1)).sum()))
        for i in range(n):
            same = key == key[i]
            if same.sum() > 1:
                want[i] = (pair(same & (np.arange(n) < i)), pair(same), key[i])
        split = lambda x: (int(x & (mixing.PAIR - 1)), int(x >> 32))
        assert {int(a): (split(b), split(w), k) for a, b, w, k in zip(at, before, whole, keys)} == want
    tree = mixing.Tree(np.arange(1, 60, dtype=np.uint64) << np.uint64(40), (2 ** rng.uniform(0, 30, 59)).astype(np.int64), np.zeros(1 << mixing.BUCKET_BITS), 0)
    ways = [tree.path[a : a + n].tolist() for a, n in zip(tree.start, tree.length)]
    one, other = np.divmod(np.arange(60 * 60), 60)
    for a, b, got in zip(one, other, tree.common(one, other)):
        assert got == next((k for k, (x, y) in enumerate(zip(ways[a], ways[b])) if x != y), len(ways[a]))
    for start, way in zip(tree.start, ways):
        for k, step in enumerate(way):
            seventh = 1
            for j in range(k - k % 3, k):
                seventh = 2 * seventh + (way[j] & 1)
            assert tree.way[start + k] == (step >> 1) << 4 | seventh << 1 | step & 1
    assert mixing.halved(np.array([3, 5, 6 << 30, 2 << 30, 0, 1 << 30])).tolist() == [3, 5, 6 << 27, 2 << 27, 0, 1 << 29]


def test_counts_beyond_a_table_cell_give_scores():
    """A corpus of one word, so to say, in which a text has all of the few others: what it takes out of halved counts isn't below zero."""
    hashes, c = np.array([1, 2, 3], np.uint64) << np.uint64(40), np.array([40, 6, 3])
    words_, begin = hashes[[0] * 20 + [1, 2, 1] + [0] * 20 + [2, 1, 1, 2, 1, 1]], np.array([0, 23, 49])
    count = c[np.searchsorted(hashes, words_)]
    model = mixing.Model(49, 3, mixing.Tree(hashes, c, np.zeros(1 << mixing.BUCKET_BITS), 0)).ready("count")
    model.score(words_, begin, count, np.array([True, True]), "count")
    large = {k: v if k == "match" else np.where(v > 12, v.astype(np.int64) << 31, v) for k, v in model.sums("count")}
    assert large["zero"].max() > 1 << 32
    model.take(large)
    sent = {k: [(mixing.planes(mixing.halved(v[low : low + (1 << 20)])), len(v[low : low + (1 << 20)])) for low in range(0, len(v), 1 << 20)] if k in ("one", "two") else v for k, v in large.items()}
    other = mixing.Model(49, 3, model.tree)
    other.take(sent)
    assert all((other.pairs[k] == model.pairs[k]).all() for k in model.PAIRS)
    for task in ("fit", "score"):
        logs = model.score(words_, begin, count, np.array([True, True]), task)
    assert np.isfinite(logs).all() and (logs <= 0).all() and logs[5:15].mean() > -0.1 > -1 > logs[20]


def test_long_runs_are_encoded_as_the_library_does(spark):
    """A million line breaks, spaces and letters, through the counts, the packing and their common encoder."""
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["\n" * 1_000_000, "a " + " " * 1_000_000 + "b", "x" * 300_000, "w " * 100_000, " \t\n" * 70_000]
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    rows = frame(spark, list(enumerate(texts)))
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(rows, scratch_path(spark, "cache"), PATH).collect()}
    assert got == want
    packed = packing.pack(rows, PATH).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] - 1 for r in packed} == want
    ten_million = " " * 10_000_000
    assert encoding.encoder(PATH).encode([ten_million])[0] == tokenizer.encode(ten_million, add_special_tokens=False).ids


def test_only_distinct_misses_are_encoded(spark):
    """Equal rows, null ids, copies under other ids, and a second run: the cache gets each text once."""
    rows = [(7, "same text")] * 50 + [(None, "no id")] * 20 + [(None, "same text")] + [(i, f"copy {i % 3}") for i in range(30)] + [(1, None), (2, "")]
    cache = scratch_path(spark, "cache")
    first = tokencount.count_tokens(frame(spark, rows), cache, PATH).collect()
    assert len(first) == len(rows) and spark.read.parquet(cache).count() == 6
    again = tokencount.count_tokens(frame(spark, rows + [(99, "one more")]), cache, PATH).collect()
    assert len(again) == len(rows) + 1 and spark.read.parquet(cache).count() == 7
    tokenizer = Tokenizer.from_file(PATH)
    for d, n_bytes, n in again:
        own = {t or "" for e, t in rows + [(99, "one more")] if e == d}
        assert (n_bytes, n) in {(len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for t in own}


def test_past_their_bounds_joins_give_the_same(spark, monkeypatch):
    from ohmtide.llm import common

    rows = near_copies(3, 4, 5, 20) + [(1000 + i, "the same words in many copies of one text, again and again") for i in range(300)]
    plain_counts = sorted(map(tuple, tokencount.count_tokens(frame(spark, rows), scratch_path(spark, "cache"), PATH).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, tokencount.count_tokens(frame(spark, rows), scratch_path(spark, "cache"), PATH).collect())) == plain_counts
    monkeypatch.setattr(common, "BROADCAST_ROWS", 200_000)
