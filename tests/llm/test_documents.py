"""Operators over documents against brute force, with nulls, empties, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineament.llm import automaton, host_quality, packing, recompression, signature_tree, site_lines, token_trie
from lineament.llm.queries import tokenizer_file
from lineament.llm.words import Words

SHAPE = "doc_id long, text string, source string, n_words string, node string"


def frame(spark, texts, source="s"):
    """Texts by id; columns that clash with names the operators use."""
    return spark.createDataFrame([(i, t, source, "x", "y") for i, t in texts], SHAPE)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "delta", "été", "zwölf", "a", "of", "the", f"w{rng.randrange(400)}"])
    base = [" ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 40, 90, 200]))) for _ in range(n)]
    passage = " ".join(f"p{k}" for k in range(70))
    out = list(enumerate(base))
    for k in range(n, n + 40):
        kind, t = rng.randrange(5), base[rng.randrange(n)]
        w = t.split(" ")
        if kind == 0:
            out.append((k, t))
        elif kind == 1 and len(w) > 5:
            w[rng.randrange(len(w))] = "edited"
            out.append((k, "\n".join([" ".join(w[:4]), " ".join(w[4:])])))
        elif kind == 2:
            out.append((k, t + " " + passage + " tail" + str(k)))
        elif kind == 3:
            out.append((k, " ".join(["same"] * rng.choice([60, 130]))))
        else:
            out.append((k, passage[: rng.randrange(len(passage))] + "\t" + t))
    return out + [(500, None), (501, ""), (502, " \n\t "), (503, base[0]), (503, base[0]), (504, "long " * 30_000 + "end")]


def split(text):
    return (text or "").encode().split()


def brute_groups(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i, _ in docs)


@pytest.mark.parametrize("k,percent,cell", [(3, 90, 4096), (5, 80, 3), (2, 50, 4096)])
def test_jaccard_groups(spark, k, percent, cell):
    docs = corpus(1)
    rows = signature_tree.jaccard_groups(frame(spark, docs), k, percent, cell).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute_groups(docs, k, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_jaccard_hot_group(spark, percent):
    """Near copies of one text and unrelated texts with one long passage, in cells far beyond the block size."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    base = [f"b{k}" for k in range(100)]
    docs = []
    for i in range(90):
        w = [*base]
        for _ in range(rng.randrange(6)):
            w[rng.randrange(100)] = f"e{rng.randrange(1000)}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, " ".join([*passage, *(f"u{i}x{k}" for k in range(rng.randrange(10, 40)))])) for i in range(90)]
    want = brute_groups(docs, 3, percent)
    rows = signature_tree.jaccard_groups(frame(spark, docs), 3, percent, 8).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == want
    assert 2 < len({c for _, _, c in want}) < 180


def test_walks_go_on_until_all_pairs_are_settled():
    """A walk gives a spanning set; refuted pairs are left out of the next one, which gives others of the same groups."""
    sets = [np.arange(100, dtype=np.uint64) * np.uint64(1 << 21) + np.uint64((i % 2) << 40) for i in range(40)]
    members = [(i, i % 2, 100, signature_tree.signature(s)) for i, s in enumerate(sets)]
    pairs, skipped = signature_tree.tree_pairs(members, None, 80)
    assert len(pairs) == 1 and skipped
    refuted, rounds, limit = set(pairs), 1, 1
    while skipped:
        limit *= signature_tree.MORE
        pairs, skipped = signature_tree.tree_pairs(members, None, 80, limit, refuted)
        assert refuted.isdisjoint(pairs)
        refuted |= set(pairs)
        rounds += 1
    assert {tuple(sorted(p)) for p in refuted} == {(a, b) for a in range(40) for b in range(a + 1, 40) if (a - b) % 2} and rounds < 6
    assert signature_tree.tree_pairs(members[:20], members[20:], 80)[0] and not signature_tree.tree_pairs([m for m in members if m[1]], None, 80)[0]
    alone = [(i, i, n, x) for i, _, n, x in members]
    assert len(signature_tree.tree_pairs(alone, None, 80)[0]) == 39


def test_single_documents(spark):
    words = lambda k, n=80: " ".join(f"w{k}x{j}" for j in range(n))
    near = words(1).replace("w1x40", "other")
    rows = [(5, words(1), "a"), (3, near, "b"), (3, words(2), "c"), (3, words(2), "d"), (9, words(2).upper(), "e"), (None, words(1), "f"), (7, None, "g"), (8, "", "h"), (10, "", "i")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tag string, __words int")
    out = signature_tree.single_documents(docs)
    assert out.columns == docs.columns and {r.tag for r in out.collect()} == {"b", "c", "d", "f", "g", "h", "i"}
    assert signature_tree.single_documents(docs.limit(0)).count() == 0


def test_jaccard_edges(spark):
    rows = signature_tree.jaccard_groups(frame(spark, [(None, "a b c d"), (3, "a b c d"), (2, "A b C d")])).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(None, None), (3, 2), (2, 2)}
    assert signature_tree.jaccard_groups(frame(spark, [])).count() == 0


def brute_repeats(docs, window):
    starts = {}
    for i, t in docs:
        w = split(t)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if i is not None:
                starts[key] = min(starts.get(key, i), i)
    out = []
    for i, t in docs:
        w = split(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and starts[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [5, 50])
def test_repeated_passages(spark, window):
    docs = corpus(2) + [(None, "alpha " * 80)]
    rows = recompression.repeated_passages(frame(spark, docs), window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str) == brute_repeats(docs, window)
    assert recompression.repeated_passages(frame(spark, []), window).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=0, max_size=60), min_size=1, max_size=4))
def test_window_symbols_follow_content(texts):
    """Equal windows are named alike, wherever they stand."""
    names = np.array([7 + v * 1_000_003 for t in texts for v in t], np.uint64)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(int)
    start, symbol, place = recompression.window_symbols(names, at, 9)
    seen = {}
    for s, n, p in zip(start.tolist(), symbol.tolist(), place.tolist()):
        assert s <= p < s + 9
        assert seen.setdefault(tuple(names[s : s + 9].tolist()), n) == n


def brute_matches(docs, items, window):
    words = lambda t: automaton.item_words(t)
    wins = {}
    for i, t in items:
        w = words(t)
        for j in range(max(len(w) - window, 0) + 1) if w else ():
            wins.setdefault(tuple(w[j : j + window]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in wins}:
            for j in range(len(w) - n + 1):
                if own := wins.get(tuple(w[j : j + n])):
                    hit[j : j + n] = [True] * n
                    found |= own
        ids = sorted(found)
        out.append((i, len(w), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [200_000, 20])
def test_contamination(spark, block):
    rng = random.Random(5)
    pool = [f"k{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 8, 20, 40])))) for i in range(12)] + [(12, None), (13, "!!"), (None, "k1 k2 k3"), (3, "k0 k0")]
    docs = [(i, ", ".join(rng.choice(pool) for _ in range(rng.randrange(60))).upper()) for i in range(40)] + [(90, None), (91, ""), (92, items[3][1]), (92, items[3][1] + " x"), (None, items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    rows = automaton.contamination(frame(spark, docs), bench, 8, 2, block).collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute_matches(docs, items, 8)


def test_decontaminated(spark):
    item = " ".join(f"q{k}" for k in range(10))
    docs = [(1, "One, two. " + item + "! three four five six seven eight nine ten eleven"), (2, item + " x"), (3, "clean text"), (4, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = automaton.decontaminated(frame(spark, docs), bench)
    assert df.columns == SHAPE.replace(",", "").split()[::2]
    odd = automaton.decontaminated(frame(spark, docs).withColumn("__spans", F.lit(1)).withColumn("__KEY", F.lit("k")).withColumn("__doc_key", F.lit(2)), bench)
    assert sorted((r.doc_id, r["__spans"], r["__KEY"], r["__doc_key"]) for r in odd.collect()) == [(1, 1, "k", 2), (3, 1, "k", 2), (4, 1, "k", 2)]
    assert {r.doc_id: r.text for r in df.collect()} == {1: "One, two. ! three four five six seven eight nine ten eleven", 3: "clean text", 4: None}
    assert automaton.decontaminated(frame(spark, docs), bench.limit(0)).count() == 4


def test_quality_counts(spark):
    docs = corpus(3)[:80] + [(600, "a\na\n\n b\n b\r\na # % <x>"), (601, None)]
    rows = {(r.doc_id, r["__n_words"], r["__word_chars"], r["__n_symbols"], r["__n_dup_lines"], r["__n_repeat_words"]) for r in host_quality.quality(frame(spark, docs)).collect()}
    want = set()
    for i, t in docs:
        w = split(t)
        tri = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        rep = {p for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want.add((i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep)))
    assert rows == want


def test_host_verdicts(spark):
    """Hosts that differ: one that fails, one that hardly does, a small one, and ordinary ones."""
    good = " ".join(f"w{k}" for k in range(60))
    junk = " ".join(f"w{k}###" for k in range(60))
    rows = [(k, good if k % 5 else "short", f"plain{k % 3}") for k in range(900)]
    rows += [(1000 + k, "short", "bad") for k in range(300)] + [(1300, good, "bad")]
    rows += [(2000 + k, good, "fine") for k in range(400)] + [(2500, junk, "fine")]
    rows += [(3000, junk, "plain0"), (3001, junk, "small"), (3002, good, "small"), (3003, good, None), (3004, None, "fine")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, n_words string, __kept int")
    out = host_quality.quality(docs).collect()
    verdict = {r.source: r["__host_verdict"] for r in out}
    assert verdict == {"plain0": "ordinary", "plain1": "ordinary", "plain2": "ordinary", "bad": "rejected", "fine": "trusted", "small": "ordinary", None: "ordinary"}
    kept = {r.doc_id for r in out if r["__kept"]}
    assert kept == {i for i, t, h in rows if h != "bad" and (t == good or t == junk and h == "fine")}
    accepted = host_quality.accepted(docs)
    assert accepted.columns == docs.columns and {(r.doc_id, r["__kept"]) for r in accepted.collect()} == {(i, 1) for i in kept}
    assert host_quality.accepted(docs.limit(0)).count() == host_quality.quality(docs.limit(0)).count() == 0


def test_beta_prior_by_hand(spark):
    hosts = [(10, 1), (20, 10), (5, 0)]
    n, fails = sum(a for a, _ in hosts), sum(b for _, b in hosts)
    mean = fails / n
    between = sum(b * b / a for a, b in hosts) / n - mean**2 - mean * (1 - mean) * len(hosts) / n
    weight = max(mean * (1 - mean) / between - 1, 1.0)
    got = host_quality.beta_prior(spark.createDataFrame(hosts, "n long, failed long"))
    assert got == pytest.approx((mean * weight, (1 - mean) * weight))


def test_site_lines(spark):
    docs = [(k, f" Menu \nbody {k}\n\nMenu") for k in range(30)] + [(40, None), (41, ""), (42, "Menu")]
    out = site_lines.site_lines_removed(frame(spark, docs).withColumn("lines", F.lit(1)).withColumn("__lines", F.lit(2)).withColumn("__Host", F.lit(3)).withColumn("__n_lines", F.lit("x")))
    assert {(r["__lines"], r["__Host"]) for r in out.collect()} == {(2, 3)} and out.schema["__n_lines"].dataType.simpleString() == "bigint"
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[3].text == "body 3\n" and rows[3]["__n_dropped"] == 2 and rows[40].text is None and rows[41].text == "" and rows[42].text == ""
    few = site_lines.site_lines_removed(frame(spark, docs[:9]))
    assert {r.doc_id: r.text for r in few.collect()} == dict(docs[:9])
    assert site_lines.site_lines_removed(frame(spark, []), "source").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcé▁", max_size=8), max_size=12))
def test_trie_counts(words):
    model = token_trie.Model({"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -2.2, "▁a": -1.2, "▁ab": -4.0, "c": -3.0, "ca": -3.5})

    def best(w):
        top = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            able = [(top[s][0] + model.scores[w[s:e]], top[s][1] - 1) for s in range(e) if w[s:e] in model.scores]
            if w[e - 1] not in model.scores:
                able.append((top[e - 1][0] + model.unknown, top[e - 1][1] - len(w[e - 1].encode())))
            top.append(max(able))
        return -top[-1][1]

    trie = token_trie.Trie(model)
    assert {w: trie.count(w) for w in words} == {w: best(w) for w in words}


def test_token_counts(spark):
    """Whole texts against a segmentation that scores every prefix of every word anew, with probabilities counted apart."""
    import math

    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    docs = [(1, "The cat sat"), (2, None), (3, ""), (4, "The The\ncat"), (5, "中\U0001f600 unbelievable"), (5, "The cat sat"), (6, " ".join(f"w{k}ord" for k in range(3000)))]
    docs += [(k, t) for k, t in corpus(4) if k < 90 and k > 6]
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    found = Counter(i for _, t in docs for w in (t or "").split() for i in p.encode(w))
    known = token_trie.text_pieces(path)
    total = sum(found[i] for i in known) + len(known)
    scores = {piece: math.log((found[i] + 1) / total) for i, piece in known.items()}
    unknown, longest = min(scores.values()) - 10, max(map(len, scores))

    def tokens(w):
        top = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            able = [(top[s][0] + scores[w[s:e]], top[s][1] - 1) for s in range(max(0, e - longest), e) if w[s:e] in scores]
            if w[e - 1] not in scores:
                able.append((top[e - 1][0] + unknown, top[e - 1][1] - len(w[e - 1].encode())))
            top.append(max(able))
        return -top[-1][1]

    rows = token_trie.token_counts(frame(spark, docs), path).collect()
    assert sorted((r.doc_id, r["__n_pretokens"], r["__n_tokens"]) for r in rows) == sorted((i, len((t or "").split()), sum(tokens("▁" + w) for w in (t or "").split())) for i, t in docs)
    assert token_trie.token_counts(frame(spark, []), path).count() == 0


def test_trie_begins_anew_when_full(spark, monkeypatch):
    model = token_trie.Model({"▁a": -1.0, "b": -1.5, "ab": -2.0})
    trie = token_trie.Trie(model)
    first = [trie.count(w) for w in ("▁ab", "▁abb", "▁b")]
    trie.clear()
    assert first == [trie.count(w) for w in ("▁ab", "▁abb", "▁b")] == [2, 3, 4]


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_long_patterned_words_stay_apart(spark, n):
    """Words that polynomial hashes modulo a power of two take for one another."""
    x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    assert len(set(Words(pa.array([x + " " + y])).names().tolist())) == 2
    rest = " ".join(f"r{k}" for k in range(60))
    docs = frame(spark, [(1, x), (2, y), (3, f"{x} {x} {x} {y}"), (4, f"{rest} {x} {rest}"), (5, f"{rest} {y} {rest}"), (6, f"{x}\n{y}\n{x}")])
    groups = {r.doc_id: r.component_id for r in signature_tree.jaccard_groups(docs, 1, 99).collect()}
    assert groups == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 3}
    counted = {r.doc_id: (r["__n_dup_lines"], r["__n_repeat_words"]) for r in host_quality.quality(docs.filter("doc_id in (3, 6)")).collect()}
    assert counted == {3: (0, 0), 6: (1, 0)}
    bench = spark.createDataFrame([(1, x)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in automaton.contamination(docs, bench).collect()} == {1: 1, 2: 0, 3: 3, 4: 1, 5: 0, 6: 2}
    rows = [(i, t) for i, t in ((4, f"{rest} {x} {rest}"), (5, f"{rest} {y} {rest}"))]
    got = recompression.repeated_passages(frame(spark, rows), 70).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows, 70)


ODD = ["", "a  b", " lead", "trail ", "a \n b\n\n  c", "it's  o'clock 's", "x <|endoftext|> y<|endoftext|>z", "　wide nb \x1c sep", "tabs\t\t x 12345 ?!  ", "é\U0001f600 mixed", "a\r\n b"]


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    mine, theirs = packing.Encoder(path), Tokenizer.from_file(path)
    import pyarrow.parquet as pq

    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()[:60]
    for t in texts:
        assert np.frombuffer(mine.encode(t), np.uint32).tolist() == theirs.encode(t, add_special_tokens=False).ids, t


def test_packing(spark):
    docs = [(k, "word " * (37 * k % 700)) for k in range(120)] + [(500, None), (501, ""), (501, ""), (None, "x"), (502, "many " * 3000)]
    rows = packing.packed(frame(spark, docs), tokenizer_file("byte_bpe_50k.json"), window=256, keep_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    encoder = packing.Encoder(tokenizer_file("byte_bpe_50k.json"))
    for i, t in docs:
        own = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.frombuffer(encoder.encode(t or ""), np.int32).tolist() + [0]
        if i != 501:
            assert [x for r in own for x in r.ids] == ids and [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
    assert len(by_doc[501]) == 2
    pad = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        pad += 0 if at & (at - 1) == 0 else 256 - at
    assert pad < 0.05 * sum(r.length for r in rows)
    assert packing.packed(frame(spark, []), tokenizer_file("byte_bpe_50k.json")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_uses_the_histogram_up(histogram):
    left = Counter(histogram)
    for lengths, times in packing.plan(histogram, 64):
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            left[n] -= times
    assert not any(left.values())


def test_words_of_slices():
    import pyarrow as pa

    a = pa.array(["x", None, "a  b\nc", "", "é ü", "\x0b\x1cq"]).slice(1)
    w = Words(a)
    assert w.count.tolist() == [0, 3, 0, 2, 1]
    assert [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)] == ["a", "b", "c", "é", "ü", "\x1cq"]
