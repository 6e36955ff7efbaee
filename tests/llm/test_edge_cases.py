"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from fieldloom.llm import bytehash, components, external_queue, induced_sort, ngram_join, nn_descent, page_text, quality_knn, quality_rules, streaming_bpe, suffix_dedup, token_pack, url_filter, warc
from fieldloom.llm.external_queue import Scratch
from fieldloom.llm.induced_sort import suffix_order

from .test_against_brute_force import base_counts, components as brute_components, repeats, shingles

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, node long, h string"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, None, s, None, 1.0, None, 3, "x") for d, t, s in rows], DOCS)


def odd_texts():
    r = random.Random(5)
    words = [f"w{k}é" for k in range(3000)]
    long = " ".join(r.choice(words) for _ in range(30_000))
    base = " ".join(r.choice(words) for _ in range(120))
    near = base.split()
    near[60] = "changed"
    return [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, " ".join(near), None), (4, None, "a"), (5, "", "b"), (6, " \t\n\v\f\r ", "b"), (7, "one two", "b"),
        (8, "ONE\ttwo", "b"), (9, long, "a"), (10, long + " tail", "a"), (None, base, None), (None, None, None), (12, "x" * 5000, "c"), (13, "<|endoftext|> it's<|startoftext|>", "c"),
        (14, "\n".join(["same line of text here"] * 40), "c"), (15, "á b c \U0001f600 ß", "c"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_texts())


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def test_packing(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out = token_pack.pack_documents(odd, path).toPandas()
    want = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _ in odd_texts())
    assert out.length.sum() == want and out.groupby("sequence_id").length.sum().max() <= 4096
    assert token_pack.pack_documents(none, path).count() == 0


def test_word_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), token_pack.WordEncoder(path)
    r = random.Random(6)
    parts = ["the", "The", "É", "e\u0301", "ß", "\u0130x", "ΣΑΣ", "it's", "'ll", "don't,", "12", "a1", "!!", "?!.", "|", "<|endoftext|>", "<|startoftext|>", ".", ",", " ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "日本", "\u1100\u1161", "😀", "x" * 100, "...", "'", "s", "_", "$$$", "&&&", "\u0301"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(400)] + ["", " ", "\n"]
    for k in range(0, len(texts), 40):
        got = e.many(texts[k : k + 40])
        assert got == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts[k : k + 40]]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_capacity(rule):
    r = np.random.default_rng(1)
    n = np.sort(r.integers(1, 100, 500))[::-1]
    limits = token_pack.Capacities(100, 3, 4000.0 + 6000).vector()
    where, offset = token_pack.best_fit(n, limits, np.array([1, 0.1, 0.1]), rule)
    for b in range(where.max() + 1):
        mine = n[where == b]
        assert mine.sum() <= 100 and len(mine) <= 3 and (mine.astype(float) ** 2).sum() <= 10_000 + 1e-3
        assert sorted(offset[where == b]) == list(np.cumsum([0, *mine[np.argsort(offset[where == b])][:-1]]))


def test_bpe(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    got = sorted(tuple(r) for r in streaming_bpe.digest_documents(odd, path).toPandas()[["n_tokens", "ids_sha256", "decoded_sha256"]].itertuples(index=False))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for _, x, _ in odd_texts():
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert streaming_bpe.digest_documents(none, path).count() == 0
    full = streaming_bpe.encode_documents(odd.where("doc_id in (7, 13)"), path).toPandas()
    assert all(list(i) == t.encode(d, add_special_tokens=False).ids for i, d in zip(full.ids, full.decoded, strict=True))


def test_bpe_window_is_bounded_and_exact():
    c = streaming_bpe.codec(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(2)
    for alphabet in ("a", "ab", "thean", "abcdefghijklmnopqrstuvwxyz", "0123456789"):
        data = "".join(r.choice(alphabet) for _ in range(4000)).encode()
        t = streaming_bpe.Transducer(c.vocabulary, c.lookahead)
        ids = []
        while data:  # fed in uneven parts
            n = r.randrange(1, 700)
            ids += t.feed(data[:n])
            data = data[n:]
        ids += t.end()
        whole = b"".join(c.vocabulary.bytes_of[i] for i in ids)
        assert ids == streaming_bpe.merge([c.vocabulary.byte_ids[b] for b in whole], c.vocabulary.merges)
        assert t.most <= 4 * c.lookahead + 512


def test_decoder_splits_characters():
    c = streaming_bpe.codec(public_tokenizers.path("byte_bpe_50k.json"))
    d = streaming_bpe.Decoder(c.vocabulary)
    data = "é\U0001f600 日本".encode() + b"\xff\xe2\x82"
    text = "".join(d.feed([c.vocabulary.byte_ids[b]]) for b in data) + d.end()
    assert text == data.decode("utf-8", "replace")


def test_classes_are_those_of_the_tokenizer_over_all_code_points():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    c, t = streaming_bpe.Codec(path), Tokenizer.from_file(path)
    points = [chr(x) for x in [*range(0xD800), *range(0xE000, 0x33480), *range(0xE0000, 0xE0200)]]
    for k in range(0, len(points), 997):
        text = "".join(x + "'re " + x + x + "1" + x + "a " for x in points[k : k + 997])
        assert c.encode(text) == t.encode(text, add_special_tokens=False).ids
    for text in ("x" * 200_000, "ab1!" * 50_000, ("é" * 70_000 + "12!?") * 2, "\n" * 150_000, " " * 150_001 + "a", chr(0x323B0) * 70_000):
        assert c.encode(text) == t.encode(text, add_special_tokens=False).ids
        assert max(len(ids) for ids, _ in c.segments(text)) < 1 << 20


def test_words_that_collide_under_a_polynomial_differ():
    """Thue-Morse words of 1024 letters and their complements have one hash under any polynomial modulo 2**64."""
    a = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    for words in ((a, b), (a[:500], b[:500]), ("x" + a, "x" + b)):
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        cut = len(words[0])
        one, two = bytehash.shingle_sets(raw, np.array([0, cut + 1, len(raw)]))
        assert one.tolist() != two.tolist()
    data = np.frombuffer((a + b).encode(), np.uint8)
    start = np.array([0, 1024, 0, 1024])
    h = bytehash.run_hashes(data, start, start + np.array([300, 300, 1024, 1024]))
    assert len(set(h.tolist())) == 4
    twice = np.frombuffer(b"Word word WORD wOrD longer-word-of-twenty longer-word-of-twenty", np.uint8)
    start, end, _ = bytehash.words(twice, np.array([0, len(twice)]))
    assert len(set(bytehash.run_hashes(twice, start, end, lower=True).tolist())) == 2 and len(set(bytehash.run_hashes(twice, start, end).tolist())) == 5


def test_ngram_join(spark, odd, none):
    out = ngram_join.jaccard_components(odd).toPandas()
    assert len(out) == len(odd_texts())
    known = out[out.doc_id.notna()].drop_duplicates("doc_id").set_index("doc_id")
    sets = {d: shingles(t) for d, t, _ in odd_texts() if d is not None}
    want = brute_components(sorted(sets), sets)
    assert {d: known.loc[d].component_id for d in sets} == want and {d: known.loc[d].n_shingles for d in sets} == {d: len(s) for d, s in sets.items()}
    assert out[out.doc_id.isna()].component_id.isna().all()
    assert ngram_join.jaccard_components(none).count() == 0


def test_ngram_join_on_a_large_group_of_near_copies(spark):
    r = random.Random(9)
    words = [f"v{k}" for k in range(400)]
    base = [r.choice(words) for _ in range(90)]
    rows = []
    for d in range(500):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(90)] = r.choice(words)
        rows.append((d, " ".join(w + [r.choice(words) for _ in range(r.randrange(3))]), "a"))
    rows += [(1000 + d, " ".join([r.choice(words) for _ in range(60)] + base[:20]), "a") for d in range(100)]
    out = ngram_join.jaccard_components(documents(spark, rows)).toPandas()
    sets = {d: shingles(t) for d, t, _ in rows}
    assert dict(zip(out.doc_id, out.component_id, strict=True)) == brute_components(sorted(sets), sets)


def test_ngram_join_counts_every_link(spark, odd, monkeypatch):
    r = random.Random(10)
    words = [f"v{k}" for k in range(400)]
    rows = [(d, t, s) for d, t, s in odd_texts()]
    for g, k in enumerate((700, 40, 2)):
        base = [r.choice(words) for _ in range(90)]
        for d in range(k):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(90)] = r.choice(words)
            rows.append((1000 * g + 100 + d, " ".join(w), "a"))
    rows += rows[100:130] + [(5000 + d, t, s) for d, (_, t, s) in enumerate(rows[200:220])]  # repeated rows, and copies
    sets = {t: frozenset(shingles(t)) for _, t, _ in rows}
    kinds = list({sets[t] for d, t, _ in rows if d is not None and sets[t]})
    near = {a: sum(100 * len(a & b) >= 75 * len(a | b) for b in kinds) - 1 for a in kinds}
    want = sorted((-1 if d is None else d, len(sets[t]), near[sets[t]] if d is not None and sets[t] else 0) for d, t, _ in rows)
    assert max(n for _, _, n in want) > 300
    for blocks, shingles_of in ((8, 1 << 21), (1, 2000)):
        monkeypatch.setattr(ngram_join, "_BLOCKS", blocks)
        monkeypatch.setattr(ngram_join, "_BLOCK_SHINGLES", shingles_of)
        out = ngram_join.jaccard_components(documents(spark, rows)).toPandas()
        assert sorted((-1 if d != d or d is None else int(d), n, k) for d, n, k in zip(out.doc_id, out.n_shingles, out.links, strict=True)) == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 400), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(101)} | {400: 400, 500: 400}


def test_forest_of_blocks(spark):
    rng = np.random.default_rng(5)
    u, v = rng.integers(0, 900, 600), rng.integers(0, 900, 600)
    label = {int(x): int(x) for x, y in zip(u, v, strict=True) if x != y} | {int(y): int(y) for x, y in zip(u, v, strict=True) if x != y}
    for _ in label:
        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            if x != y:
                label[x] = label[y] = min(label[x], label[y])
    nodes, roots = components.forest(np.maximum(u, v)[u != v], np.minimum(u, v)[u != v])
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {k: r for k, r in label.items() if k != r}
    edges = spark.createDataFrame(list(zip(u.tolist(), v.tolist(), strict=True)), "a long, b long")
    for block in (40, 1 << 20):  # many blocks, whose forests the stars join, and one
        assert {r.node: r.component for r in components.connected_components(edges, block=block).collect()} == label
    assert components.connected_components(edges.where("a is null")).count() == 0


def test_suffix_dedup(spark, odd, none):
    rows = [(d, t) for d, t, _ in odd_texts() if d is not None]
    out = suffix_dedup.digests(odd).toPandas()
    assert len(out) == len(odd_texts())
    # the texts of a null doc_id come first in the order
    want = repeats([(-1, t) for d, t, _ in odd_texts() if d is None][:1] + list(dict.fromkeys(rows)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out[out.doc_id.notna()].itertuples()}
    assert got == {d: w for d, w in want.items() if d >= 0}
    assert suffix_dedup.digests(none).count() == 0


def test_suffix_dedup_on_many_shared_passages(spark):
    r = random.Random(4)
    passages = ["".join(r.choice("ab ") for _ in range(r.randrange(90, 260))) for _ in range(12)]
    rows = [(d, "".join(r.choice(passages)[r.randrange(20) :] + "".join(r.choice("xyz") for _ in range(r.randrange(30))) for _ in range(r.randrange(6))), "a") for d in range(150)]
    out = suffix_dedup.digests(documents(spark, rows)).toPandas()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.itertuples()} == repeats([(d, t) for d, t, _ in rows])


def test_a_shard_beyond_the_memory_limit(monkeypatch):
    """Text, recursion and results of 0.4 million bytes in pieces and queues that hold far less, against all strings."""
    import tracemalloc

    monkeypatch.setattr(suffix_dedup, "_ROWS", 1 << 12)
    monkeypatch.setattr(induced_sort, "_PIECE", 1 << 12)
    monkeypatch.setattr(induced_sort, "_MOST", 1 << 12)
    monkeypatch.setattr(induced_sort, "_BASE", 1 << 12)
    monkeypatch.setattr(external_queue, "_PIECE", 1 << 12)
    r = np.random.default_rng(2)
    texts = [r.integers(97, 123, 1000, np.uint8).tobytes() for _ in range(200)]
    texts += [b"ab" * 500, b"a" * 2000] + [texts[k % 150][: 300 + k % 500] + b"%d" % k + texts[(7 * k) % 150][200:] for k in range(200)]
    with Scratch(1 << 15) as scratch:
        pieces = suffix_dedup.Pieces(scratch)
        for doc, data in enumerate(texts):
            pieces.add(doc, 0, data)
        tracemalloc.start()
        found = list(pieces.spans(100))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert scratch.made > 100 and pieces.size > 400_000
        assert most < 8 * pieces.size  # less than the suffix array alone
    removed = collections.defaultdict(set)
    for doc, start, end in (x for f in found for x in zip(*(a.tolist() for a in f), strict=True)):
        removed[doc].update(range(start, end))
    want = repeats([(d, t.decode()) for d, t in enumerate(texts)])
    assert {d: len(removed[d]) for d in want} == {d: w[1] for d, w in want.items()}


@pytest.mark.parametrize("memory", [64, 1 << 20])
@pytest.mark.parametrize("piece", [7, 1 << 16])
def test_suffix_order(memory, piece, monkeypatch):
    monkeypatch.setattr(induced_sort, "_PIECE", piece)
    monkeypatch.setattr(external_queue, "_PIECE", max(piece, 16))
    r = random.Random(3)
    for _ in range(60):
        k, n, cap = r.choice([2, 3, 30]), r.randrange(1, 150), r.choice([5, 100])
        t = [r.randrange(1, k + 1) for _ in range(n)]
        a, b, c = r.randrange(n), r.randrange(n), r.randrange(60)
        t[b : b + c] = t[a : a + c]
        t.append(0)
        with Scratch(memory) as scratch:
            order, shared = suffix_order(np.array(t, np.int64), k + 1, cap, scratch, base=r.choice([0, 10, 1000]))
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert list(order) == want
        for x, y, s in zip(want, want[1:], shared[1:], strict=False):
            assert s == min(cap, next(i for i in range(len(t)) if t[x + i] != t[y + i]))


def test_classifier(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 1), (14, 0), (None, 1), (12, None), (99, 0)], "doc_id long, quality int")
    out = quality_knn.classify(odd, labels).toPandas()
    assert len(out) == len(odd_texts()) and out.score.between(0, 1).all() and out.held_out.notna().all()
    assert quality_knn.classify(none, labels).count() == 0
    assert (quality_knn.classify(odd, labels.where("false")).toPandas().score == 0.5).all()


def test_quality_rules(odd, none):
    out = quality_rules.quality_rules(odd).toPandas()
    assert len(out) == len(odd_texts())
    got = sorted(tuple(r) for r in out[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].itertuples(index=False))
    assert got == sorted(base_counts(t) for _, t, _ in odd_texts())
    assert quality_rules.quality_rules(none).count() == 0
    kept = quality_rules.kept_documents(odd)
    assert kept.columns == odd.columns


def test_repeated_words_are_exact_whatever_the_hash(odd):
    want = sorted(base_counts(t) for _, t, _ in odd_texts())
    for bits in (64, 24, 3):  # the long texts have windows with the same 24 bits
        out = quality_rules.counted_texts(odd.where("text is null or length(text) < 2000" if bits == 3 else "true"), bits).toPandas()
        got = sorted(tuple(r) for r in out[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].itertuples(index=False))
        assert got == (want if bits > 3 else sorted(base_counts(t) for _, t, _ in odd_texts() if len(t or "") < 2000))


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    r = random.Random(1)
    words = [f"u{k}" for k in range(5000)]
    line = "this line stands on very many pages of the host"
    rows = [(d, line + "\n" + " ".join(r.choice(words) for _ in range(80)), "h") for d in range(60)]
    rows += [(100 + d, "\n".join([line, line.upper(), "  " + line.replace(" ", "  ")] * 3 + [f"own {d} a b c d"]), "h") for d in range(5)]
    rows += [(200 + d, line + "\n" + " ".join(r.choice(words) for _ in range(80)), f"g{d}") for d in range(5)]
    docs = documents(spark, rows)
    out = quality_rules.quality_rules(docs).toPandas().set_index("doc_id")
    assert out.loc[range(60)].kept.all() and (out.loc[range(60)].removed_words == 10).all()
    assert not out.loc[range(100, 105)].kept.any()
    assert (out.loc[range(200, 205)].removed_words == 0).all()
    kept = quality_rules.kept_documents(docs).toPandas().set_index("doc_id")
    assert all(line not in kept.loc[d].text for d in range(60)) and all(line in kept.loc[200 + d].text for d in range(5))


def test_the_limit_falls_behind_a_growing_host(spark):
    counted = spark.range(100_000).selectExpr("id doc_id", "'h' host", "id content", "filter(array(struct(1L line, 5 n), struct(2L line, 5 n)), x -> x.line = 1 and id < 7000 or x.line = 2 and id < 6000) lines")
    assert [r.line for r in quality_rules.frequent_lines(counted).collect()] == [1]  # 20 times the root of 100,000 is 6325


def test_quality_rules_run_no_python(odd):
    counted = quality_rules.counted_texts(odd)
    frequent = quality_rules.frequent_lines(counted)
    for df in (quality_rules.quality_rules(odd), counted, frequent, quality_rules.removed_words(counted.withColumn("row", F.lit(1)), frequent)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node long, s string")


def test_neighbours(spark):
    r = np.random.default_rng(0)
    good = [(k, [float(x) for x in r.standard_normal(8)], 1, 0, "") for k in range(70)]
    good += [(100 + k, good[0][1], 1, 0, "") for k in range(40)]  # ties
    bad = [(300, None, 1, 0, ""), (320, [0.0] * 8, 1, 0, ""), (340, [1.0] * 7 + [None], 1, 0, ""), (360, [float("nan")] * 8, 1, 0, ""), (380, [1.0] * 3, 1, 0, ""), (None, [1.0] * 8, 1, 0, ""), (400, [], 1, 0, "")]
    out = nn_descent.search(vectors(spark, good + bad + good[:3])).toPandas()
    v = np.array([g[1] for g in good], np.float32).astype(float)
    ids = np.array([g[0] for g in good])
    for q in ids[ids % 20 == 0]:
        s = v @ v[list(ids).index(q)]
        want = [int(ids[k]) for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        assert list(out[out.query_id == q].sort_values("rank").vec_id) == want
    assert set(out.query_id) == set(ids[ids % 20 == 0].tolist())
    assert nn_descent.search(vectors(spark, [])).count() == 0
    assert nn_descent.search(vectors(spark, good[:1])).count() == 0


PAGES = "page_id long, url string, html string, text string, lines long, host string"


def pages(spark, rows):
    return spark.createDataFrame([(p, u, h, "t", 1, "x") for p, u, h in rows], PAGES)


def test_page_text(spark):
    plain = "<div>Top shared line</div><div>Own {}</div><div>Bottom shared line</div>"
    rows = [
        (1, "http://a.com/x/1", plain.format("one")), (2, "http://a.com/x/2", plain.format("two")), (3, "http://b.com/z", plain.format("alone")), (4, None, None), (5, "no url", ""),
        (6, "http://c.com/1", "<header>h</header><main><h1>T&amp;T</h1><p>a <b>b</b>\n c<br>d<p>e&nbsp;f<aside>no</aside><form>no</form><script>x<y</script><!-- c --><style>z</style></main><div class='comments'>no</div>"),
        (7, "http://c.com/2", "<nav><ul><li>x</li></ul></nav><article><p>same</p><p>own</p><div id=\"cookie-notice\">no</div></article><footer>f"),
        (8, "http://c.com/3", "<nav><article><p>same</p><p>other &#x41;&lt;</p>"), (None, "http://c.com/4", "<p>q</p>"), (3, "http://b.com/z", plain.format("alone")),
    ]
    out = page_text.extract_pages(pages(spark, rows)).toPandas()
    got = {r.page_id: r.text for r in out[out.page_id.notna()].itertuples()}
    assert len(out) == len(rows)
    assert got[1] == "Own one" and got[2] == "Own two"
    assert got[3] == "Top shared line\nOwn alone\nBottom shared line"
    assert got[4] == "" and got[5] == ""
    assert got[6] == "T&T\na b c d\ne f"
    assert got[7] == "same\nown" and got[8] == "same\nother A<"
    assert page_text.extract_pages(pages(spark, [])).count() == 0


def test_template_lines_go_from_articles_and_shared_passages_stay(spark):
    quote = "<p>A passage that two articles quote</p>"
    page = "<article><div>Share this page</div>{0}<h1>Title {1}</h1><p>own {1} words of article {1}, and well more of them than there are in all of its template lines and its quotation</p>{0}<div>All rights reserved</div></article><p>outside</p>"
    rows = [(k, f"http://t.com/a/{k}", page.format(quote if k in (2, 3, 4) else "", k)) for k in range(1, 6)]
    rows += [(10 + k, f"http://copies.com/{k}", page.format("", 0)) for k in range(3)]  # equal pages: none is a template
    rows += [(20, "http://two.com/1", page.format("", 1)), (21, "http://two.com/2", page.format("", 2))]  # one neighbour only
    got = {r.page_id: r.text for r in page_text.extract_pages(pages(spark, rows)).collect()}
    own = "Title {0}\nown {0} words of article {0}, and well more of them than there are in all of its template lines and its quotation"
    for k in range(1, 6):
        passage = "A passage that two articles quote"
        want = own.format(k) if k in (1, 5) else f"{passage}\n{own.format(k)}\n{passage}"
        edges = (f"Share this page\n{want}\nAll rights reserved") if k in (1, 5) else want
        assert got[k] == edges, k  # the first and last page of a host have one neighbour
    for k in (10, 11, 12, 20, 21):
        assert got[k].startswith("Share this page\nTitle") and got[k].endswith("All rights reserved")


def test_differencing_by_brute_force(spark):
    """Pairs by path, alignment and deletion on pages without marks, against plain Python."""
    r = random.Random(4)
    rows = []
    for host in ("a.org", "b.org", "c.org"):
        for k in range(14):
            path = "/" + "".join(r.choice("ab/") for _ in range(r.randrange(1, 9))) + str(k)
            rows.append((len(rows), f"http://{host}{path}", "".join(f"<div>line {r.randrange(12)}</div>" for _ in range(r.randrange(1, 12)))))
    rows += [(len(rows) + k, u, h) for k, (_, u, h) in enumerate(rows[:4])]

    def steps(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    lines = {p: [x for x in h.replace("</div>", "").split("<div>") if x] for p, _, h in rows}
    split = {p: (u.split("/")[2], "/" + u.split("/", 3)[3]) for p, u, _ in rows}
    got = {x.page_id: x.text for x in page_text.extract_pages(pages(spark, rows)).collect()}
    for host in ("a.org", "b.org", "c.org"):
        first = {}
        for p in lines:
            if split[p][0] == host:
                key = tuple(lines[p])
                first[key] = min(first.get(key, "~"), split[p][1])
        order = sorted(first.items(), key=lambda x: x[1])
        assert len({x for _, x in order}) == len(order)
        for k, (key, path) in enumerate(order):
            around = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order)]
            near = min(around, key=lambda x: steps(path, x[1]))[0]  # the one before wins ties
            best = np.zeros((len(key) + 1, len(near) + 1), int)
            for i, x in enumerate(key):
                for j, y in enumerate(near):
                    best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
            for p in lines:
                if split[p][0] == host and tuple(lines[p]) == key:
                    left = got[p].split("\n") if got[p] else []
                    assert len(left) == len(key) - best[-1, -1]
                    gone = collections.Counter(key) - collections.Counter(left)
                    assert not gone - collections.Counter(near)
                    it = iter(key)
                    assert all(x in it for x in left)


@pytest.mark.parametrize("kept", [32 << 20, 64])
def test_common_lines(kept, monkeypatch):
    monkeypatch.setattr(page_text, "_KEPT_BYTES", kept)
    r = random.Random(8)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(12))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        got = page_text.common_lines(a, b)
        assert len(got) == best[-1, -1] and got == sorted(set(got))
        it = iter(b)
        assert all(a[k] in it for k in got)


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://a/\r\nx: y", big), (2, None, big), (2, "http://r", big), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "z" * 999), (6, "http://f", "z" * 999), (None, "http://n", big), (7, "u", "q" * 200_000)]
    out = warc.archive_round_trip(pages(spark, rows)).toPandas()
    assert len(out) == len(rows)
    one = out[out.page_id == 1].iloc[0]
    assert (one.record_type, one.refers_to, one.payload_bytes, one.payload) == ("revisit", 2, 1200, None)
    assert (out[out.page_id != 1].record_type == "response").all()
    assert out[out.page_id == 7].iloc[0].payload == b"q" * 200_000 and one.payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_warc_reader_refuses_broken_archives():
    import io

    good = warc.encode_record(1, "http://a", b"payload" * 300, None, "2020-01-01T00:00:00Z", 6)
    assert [r["payload"] for r in warc.records(io.BytesIO(good + good))] == [b"payload" * 300] * 2
    import gzip

    text = gzip.decompress(good)
    for broken in (good[:-30], gzip.compress(text.replace(b"payload", b"pAyload", 1)), gzip.compress(text[:-3]), gzip.compress(text + b"x"), gzip.compress(b"HTTP/1.1\r\n\r\n")):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(broken)))


def test_urls(spark):
    rows = [(1, None, ""), (2, "nothing", ""), (3, "HTTP://WWW.Casino-Win.Example.NET/a?b", ""), (4, "https://x.org", ""), (5, "https://a.example.org/en/12#z", ""), (6, "://é.com/de/", ""), (None, "http://m.freebets.net:80/fr/?q", ""), (8, "http://" + "a" * 3000 + ".net/", "")]
    out = url_filter.judge_urls(pages(spark, rows), VOCABULARY).toPandas()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out[out.page_id.notna()].itertuples()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.casino-win.example.net", "/a", None, "block")
    assert got[4] == ("x.org", "", None, "allow") and got[5] == ("a.example.org", "/en/12", "example.org/en/1", "block") and got[6] == ("é.com", "/de/", "com/de/", "block")
    last = out[out.page_id.isna()].iloc[0]
    assert last.verdict == "block" and list(last.words)[:3] == ["m", "free", "bets"]
    assert url_filter.judge_urls(pages(spark, []), VOCABULARY).count() == 0


def plain_cut(name, counts, total):
    """Viterbi over every begin of every word."""
    best = [(0.0, ())]
    for end in range(1, len(name) + 1):
        found = []
        for begin in range(end):
            word = name[begin:end]
            cost = math.log(total / counts[word]) if word in counts else math.log(total) + len(word) * math.log(10)
            found.append((best[begin][0] + cost, (*best[begin][1], word)))
        best.append(min(found, key=lambda x: x[0]))
    return list(best[-1][1])


def test_names_are_cut_and_judged_as_by_brute_force(spark):
    fill = ["zq" + "".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in range(20_000)]
    long = "abcdefghijklmnopqrstuvwxyzabcdefghijkl"
    paths = ["/".join(fill[k : k + 500]) for k in range(0, len(fill), 500)] * 5 + [f"sussexground/{long}"] * 4
    text = "<style>stylish</style><p class='classy'>Quuxling, the&nbsp;quuxling<!-- hidden --> SUSSEXGROUND</p>"
    rows = [(k, "http://x.net/" + path, text if k < 3 else None) for k, path in enumerate(paths)]
    hosts = ["playground", "sussexgroundplayground", "onlinecasinobonus", "freepornvideos", "dailynewsreport", "viagrapills", "citylibrary", "thebestpokersite", long + "casino", "casino" * 50, "qqqq" * 20, fill[7] + "win", "quuxlingforum", "stylish"]
    rows += [(1000 + k, f"http://{host}.net/", "") for k, host in enumerate(hosts)]
    out = {r.page_id: r for r in url_filter.judge_urls(pages(spark, rows), VOCABULARY).where("page_id >= 1000").collect()}
    seen = collections.Counter(w for path in paths for w in path.split("/")) + collections.Counter({"quuxling": 6, "the": 3, "sussexground": 3})
    known = url_filter.lexicon(VOCABULARY)
    assert abs(sum(known.values()) - 1) < 1e-9
    weight = max(1e6, sum(seen.values()))
    counts = collections.Counter({w: x * weight for w, x in known.items()})
    for w, n in seen.items():
        counts[w] += n
    total = sum(seen.values()) + weight + 1
    want = [plain_cut(host, counts, total) + ["net"] for host in hosts]
    assert [out[1000 + k].words for k in range(len(hosts))] == want
    assert want[1] == ["sussexground", "playground", "net"] and want[2] == ["online", "casino", "bonus", "net"] and want[12] == ["quuxling", "forum", "net"]
    assert want[8] == [long, "casino", "net"] and want[9] == ["casino"] * 50 + ["net"]

    def bayes(words):
        """Log odds by the definition: shares of a class's words, one added to every count."""
        examples = {}
        for name, kinds in (("bad", url_filter.BLOCKED), ("good", url_filter.ALLOWED)):
            examples[name] = [w + s for x in kinds.values() for w in x.split() for s in ("", "s")] + url_filter.NEUTRAL * len(kinds)
        kinds = {w for x in examples.values() for w in x}
        share = lambda c, w: (examples[c].count(w) + 1) / (len(examples[c]) + len(kinds))
        return sum(math.log(share("bad", w) / share("good", w)) for w in words if w in kinds)

    for k, words in enumerate(want):
        r = out[1000 + k]
        assert abs(r.score - bayes(words)) < 1e-9 and r.verdict == ("block" if bayes(words) > 0 else "allow")
    assert [out[1000 + k].verdict for k in range(10)] == ["allow", "allow", "block", "block", "allow", "block", "allow", "block", "block", "block"]


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, sf_dir)
        if k == len(P.STAGES) - 1:
            break
        assert docs.columns == P.COLUMNS
        rows = {r.doc_id: r for r in docs.collect()}
        assert set(rows) <= set(before) and len(rows) > 0.3 * len(before)
        if k == 2:
            sets = {d: shingles(r.text) for d, r in before.items()}
            parts = brute_components(sorted(sets), sets)
            assert set(rows) == {d for d, c in parts.items() if d == c}
        if k == 3:
            want = repeats([(d, r.text) for d, r in before.items()])
            assert all(len(rows[d].text.encode()) <= w[0] - w[1] for d, w in want.items())
            assert all(rows[d].text == before[d].text for d, w in want.items() if not w[1])
        before = rows
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
    assert docs.select("doc_id").distinct().count() == len(before)
    assert docs.where(F.col("offset") + F.col("length") > 4096).count() == 0
