"""The training-data operators against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import html as entities
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import ann, bpe, common, ctw, html, jaccard, language, lines, mixing, repeats, topk, vectors

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SF = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta epsilon " * 4000

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today\nsecond line of the text with many words in it to be long", "en", "a"),
    (2, "the quick brown fox jumps over the lazy cat and runs far away from here today\nsecond line of the text with many words in it to be long", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \t\n ", "de", None),
    (6, "12345 !!!", "de", None),
    (7, LONG, "fr", "a"),
    (8, "the quick brown fox jumps over the lazy dog and runs far away from here today\nsecond line of the text with many words in it to be long", "en", "c"),
    (8, "the quick brown fox jumps over the lazy dog and runs far away from here today\nsecond line of the text with many words in it to be long", "en", "c"),
    (None, "a document without an id has words like any other one in the table", "en", "a"),
    (9, "Über die Brücke geht der Weg, und wir gehen ihn heute zusammen mit allen Freunden", "de", "d"),
    (10, "one\x1fword   stays", "en", "a"),
]
DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(TEXTS, DOCS)
    for extra in ("n", "rep", "size", "bucket", "slice", "rank", "hash", "kept", "line", "salt", "flag"):
        frame = frame.withColumn(extra, F.lit("mine"))
    return frame


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def real_texts(real):
    return {r["doc_id"]: r["text"] for r in real.select("doc_id", "text").collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert language.identify(none, language.learn_profiles(none)).count() == 0
    assert bpe.encode_documents(none).count() == 0
    assert ctw.score_documents(none, F.lit(True)).count() == 0
    assert jaccard.similar_documents(none).count() == 0 and jaccard.one_of_each(none).count() == 0
    assert repeats.repeated_passages(none).count() == 0
    assert lines.deduplicated(none).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    v = vectors.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_inner_products(v, v).count() == 0 and ann.Index(v).search(v).count() == 0


# 1 scoring


def kt_tree(texts, depth):
    """Counts of every context's decision nodes by plain recursion."""
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        data = b"\n" * depth + t
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                for bit in range(8):
                    node = (data[i - d : i], bit, data[i] >> (8 - bit))
                    counts[node][data[i] >> (7 - bit) & 1] += 1
    return counts


def test_ctw_equals_plain_recursion(spark):
    depth = 3
    train, other = ["abracadabra abra", "bra cad"], ["abra dab", ""]
    rows = [(i, t, True) for i, t in enumerate(train)] + [(10 + i, t, False) for i, t in enumerate(other)]
    got = {r["doc_id"]: r for r in ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string, t boolean"), F.col("t"), depth).collect()}
    norm = lambda t: b" ".join(t.encode().split()) + b"\n"
    counts = kt_tree([norm(t) for t in train], depth)
    children = defaultdict(list)
    for context, bit, top in counts:
        if context:
            children[context[1:], bit, top].append((context, bit, top))
    log_kt = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)

    def log_w(node):
        if len(node[0]) == depth:
            return log_kt(counts[node])
        return np.logaddexp(math.log(0.5) + log_kt(counts[node]), math.log(0.5) + sum(log_w(k) for k in children[node]))

    for r in rows:
        data, total = b"\n" * depth + norm(r[1]), 0.0
        for i in range(depth, len(data)):
            for bit in range(8):
                p = None
                for d in range(depth, -1, -1):
                    node = (data[i - d : i], bit, data[i] >> (8 - bit))
                    if node not in counts:
                        continue
                    c = counts[node]
                    kt = (c[1] + 0.5) / (sum(c) + 1)
                    stop = 1.0 if d == depth else math.exp(math.log(0.5) + log_kt(c) - log_w(node))
                    p = kt if p is None else stop * kt + (1 - stop) * p
                p = 0.5 if p is None else p
                total += math.log10(p if data[i] >> (7 - bit) & 1 else 1 - p)
        assert got[r[0]]["score"] == pytest.approx(total, rel=1e-5)


def test_ctw_base_and_edges(docs):
    found = ctw.score_documents(docs, common.crc_fold(F.col("doc_id")) != 1).collect()
    assert len(found) == len(TEXTS)
    counts = Counter()
    words = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    for i, t, *_ in TEXTS:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update(words(t))
    total, vocabulary = sum(counts.values()), len(counts)
    want = {i: (len(words(t)), sum(counts[w] > 0 for w in words(t)), sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (vocabulary + 1))) for w in words(t))) for i, t, *_ in TEXTS}
    for r in found:
        n, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


# 2 and 6 vectors


@pytest.fixture(scope="module")
def some_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)]
    rows += [(500, None), (550, [1.0, None] + [0.0] * 6), (600, [float("nan")] + [0.0] * 7), (650, [0.0] * 8), (None, [1.0] * 8), (700, [1.0, 2.0]), (750, [2.0, 1.0]), (100, rows[100][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine")), rows


def usable(rows, zero):
    out = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = np.array(v, np.float32).astype(np.float64)
    return out


def test_topk_equals_brute_force(some_vectors):
    frame, rows = some_vectors
    v = vectors.usable(frame)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_inner_products(v, v.filter("vec_id % 50 = 0")).collect()}
    q = {i: np.floor(256 * x).astype(int) for i, x in usable(rows, True).items()}
    want = {}
    for i in (i for i in q if i % 50 == 0):
        best = sorted((-int(q[i] @ x), j) for j, x in q.items() if j != i and len(x) == len(q[i]))[:5]
        want |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(best)}
    assert got == want


def test_pruning_skips_blocks_and_keeps_ties():
    ids, x = np.arange(1000), np.repeat(np.arange(500.0)[:, None], 2, 0)
    got, who = topk.block_search(np.array([5000]), np.array([[1.0]]), ids, x, 3, 16)
    assert got.tolist() == [[499, 499, 498]] and who.tolist() == [[998, 999, 996]]


def test_topk_takes_negative_ids(spark):
    rows = [(i, np.array([float(i % 7), float(i * i % 11)])) for i in range(-100, 60, 10)] + [(-1, np.array([9.0, 9.0]))]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "vec_id long, v array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_inner_products(v, v.filter("vec_id % 50 = 0")).collect()}
    want = {}
    for i, q in rows:
        if i % 50 == 0:
            best = sorted((-int(65536 * (q @ x)), j) for j, x in rows if j != i)[:5]
            want |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(best)}
    assert got == want and {i for i, _ in got} == {-100, -50, 0, 50}


def test_ann_recall_and_exact_scores(some_vectors):
    frame, rows = some_vectors
    v = vectors.usable(frame).filter(F.exists("v", lambda x: x != 0))
    got = defaultdict(list)
    for r in ann.Index(v).search(v.filter("vec_id % 25 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q, hit, total = usable(rows, False), 0, 0
    for i in (i for i in q if i % 25 == 0):
        near = sorted((float(np.sqrt(((q[i] - x) ** 2).sum())), j) for j, x in q.items() if j != i and len(x) == len(q[i]))[:10]
        hit += len({j for _, j in near} & {j for j, _ in got[i]})
        total += len(near)
        assert all(s == pytest.approx(float(np.sqrt(((q[i] - q[j]) ** 2).sum())), rel=1e-12) for j, s in got[i])
    assert hit / total >= 0.9


def nearest_by_force(rows, i, k=10):
    x = dict(rows)
    return [j for _, j in sorted((float(((x[i] - y) ** 2).sum()), j) for j, y in rows if j != i)[:k]]


def test_ann_isolated_vectors_get_their_k(spark):
    rng = np.random.default_rng(3)
    near = rng.standard_normal((20, 16))[rng.integers(0, 20, 3000)] * 3 + rng.standard_normal((3000, 16)) * 0.01
    rows = [*enumerate(near), *((3000 + i, v) for i, v in enumerate(rng.standard_normal((10, 16)) * 30))]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "vec_id long, v array<double>").repartition(3)
    got = defaultdict(list)
    for r in ann.Index(v).search(v.filter("vec_id >= 3000")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for i in range(3000, 3010):
        assert got[i] == nearest_by_force(rows, i)


def test_ann_small_tables_give_all_candidates(spark):
    rows = [(i, np.array([10.0**i, -(10.0**i)])) for i in range(8)]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "vec_id long, v array<double>")
    got = defaultdict(list)
    for r in ann.Index(v).search(v).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert {i: got[i] for i in range(8)} == {i: nearest_by_force(rows, i) for i in range(8)}


# 3 lines


def test_lines_keep_the_earliest_copy(docs):
    got = {(r["doc_id"], r["source"]): r["text"] for r in lines.deduplicated(docs).collect()}
    assert got[1, "a"] == TEXTS[0][1]
    assert got[2, "a"] == "" and got[8, "c"] == ""
    assert got[3, "b"] is None and got[4, "b"] == "" and got[5, None] == " \t\n "
    assert got[None, "a"] == TEXTS[9][1]


def test_lines_insert_delete_replace(spark):
    base = [f"w{i}" for i in range(12)]
    variants = [base, base[:3] + base[4:], base[:5] + ["new"] + base[5:], base[:7] + ["other"] + base[8:], base[:2] + ["x", "y"] + base[4:], base[::-1], base[:8], base[:7] + ["zz"]]
    frame = spark.createDataFrame([(i, " ".join(v)) for i, v in enumerate(variants)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.deduplicated(frame).collect()}
    assert [i for i in got if not got[i]] == [] or sorted(i for i in got if not got[i]) == [1, 2, 3]
    assert sorted(i for i in got if not got[i]) == [1, 2, 3]


# 4 tokens


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    texts = [t for _, t, *_ in TEXTS] + ["x <|endoftext|> y<|endoftext|>", "  two  spaces \n\n tab\t.", "it's we'll 123abc ä日本🎉", "=" * 300]
    automaton = bpe.load(bpe.vocabulary_path())
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(automaton.encode(t or ""), "<u4").tolist() == ids
        assert automaton.decode(automaton.encode(t or "")) == library.decode(ids, skip_special_tokens=False)
    got = bpe.encode_documents(docs, with_tokens=True).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        raw = np.array(r["ids"], "<u4").tobytes()
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(raw).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_gadgets_on_a_small_vocabulary():
    tokens = {"a": 0, "b": 1, "aa": 2, "ab": 3, "aab": 4}
    merges = [(0, 0, 2), (0, 1, 3), (2, 1, 4)]
    automaton = bpe.Automaton(merges, {i: t.encode() for t, i in tokens.items()}, {})

    def merged(word):
        parts = list(word)
        for a, b, c in [("a", "a", "aa"), ("a", "b", "ab"), ("aa", "b", "aab")]:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (a, b):
                    parts[i : i + 2] = [c]
                i += 1
        return [tokens[p] for p in parts]

    for n in range(1, 8):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert automaton.path(word.encode()) == merged(word), word


# 5 pages


def test_html_extracts_articles(spark):
    pages = [r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    want = {}
    for r in pages:
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        want[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    got = {r["page_id"]: r for r in html.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_html_drops_what_is_no_article(spark):
    page = """<html><head><title>t</title></head><body><header class="site-header"><h1>Site</h1></header><nav><a>m</a></nav><div class="sidebar">side</div>
    <main><div class="post"><header><h1>Title &amp; more</h1></header><p>One<br>two <i>it</i>al&nbsp;x<p>Three<ul><li>a<li>b</ul><form>q</form><div id="comments"><p>c1</p></div><div class="cookie-notice">cc</div></div></main><footer>f</footer></body></html>"""
    rows = [(1, "http://a/x", page), (2, "http://a/y", None), (3, None, ""), (4, "http://b/", "just text"), (4, "http://b/", "just text"), (None, "http://a/z", page)]
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine"))).collect()}
    text = "Title & more\n\nOne two ital x\n\nThree\n\na\n\nb"
    assert got == {(1, "http://a/x"): (text, len(text)), (2, "http://a/y"): ("", 0), (3, None): ("", 0), (4, "http://b/"): ("just text", 9), (None, "http://a/z"): (text, len(text))}


def test_wrapper_is_union_free():
    one, two = html.folded(html.tree("<div><p>a</p><p>b</p></div>")), html.folded(html.tree("<div><h1>t</h1><p>c</p></div>"))
    assert html.expression(html.aligned(one, two)) == "<#root><div><h1>(#)</>?<p>(#)</>+</></>"


# 7 passages


def removed_by_force(texts: dict) -> dict:
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        mine, gone = [b[s : s + 50] for s in range(len(b) - 49)], np.zeros(len(b), bool)
        for s, w in enumerate(mine):
            if w in seen:
                gone[s : s + 50] = True
        seen.update(mine)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_passages_equal_brute_force(real, real_texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeated_passages(real).collect()}
    assert got == removed_by_force(real_texts)


def test_passages_on_edges(spark):
    rng = np.random.default_rng(1)
    shared = "".join(rng.choice(list("abcdefgh "), 300))
    texts = {1: shared[:120], 2: "x" + shared[:49], 3: shared[30:80] + "y", 4: "z" * 200, 5: "z" * 120, 6: shared[:60] + "q" + shared[60:200], 7: shared[:100] + shared[:100], 8: None, 9: ""}
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeated_passages(frame).collect()}
    assert got == removed_by_force(texts)


def test_interval_tree_finds_maximal_repeats():
    before, after = [b"xab", b"yab", b"zb"], [b"cde", b"cdf", b"cde"]
    found = {(m, n, tuple(sorted(w))) for m, n, w in repeats.maximal_repeats(before, after, 3)}
    assert (1, 3, (0, 2)) in found and (2, 2, (0, 1)) in found and (1, 2, (0, 1, 2)) in found


def test_passages_of_repeated_rows_and_nulls(docs):
    got = repeats.repeated_passages(docs.filter("doc_id IS NOT NULL")).collect()
    assert len(got) == len(TEXTS) - 1
    assert {r["n_removed"] for r in got if r["doc_id"] == 8} == {len(TEXTS[7][1])}


# 8 similarity


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_by_force(texts: dict) -> dict:
    sets, part = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        x = len(sets[a] & sets[b])
        if x and 100 * x >= 75 * (len(sets[a]) + len(sets[b]) - x):
            p, q = sorted((find(a), find(b)))
            part[q] = p
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_join_equals_brute_force(real, real_texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(real).collect()}
    assert got == components_by_force(real_texts)


def test_join_of_chains_copies_and_edits(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base, texts = [f"w{i}" for i in range(60)], {}
    for i in range(80):
        words = base.copy()
        for j in rng.choice(60, rng.integers(0, 4), replace=False):
            words[j] = f"e{rng.integers(1000)}"
        texts[i] = " ".join(words[: rng.integers(45, 61)])
    for i in range(80, 100):
        texts[i] = " ".join(f"s{k}" for k in range((i - 80) * 3, (i - 80) * 3 + 30))
    texts |= {100: "a b", 101: "A  b", 102: "", 103: None, 104: "a b c"}
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    for rows in (512, 4):
        monkeypatch.setattr(jaccard, "TILE_ROWS", rows)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(frame).collect()}
        assert got == components_by_force(texts)


def test_one_document_of_each_group(docs):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 6, 7, 9, 10)] + [(True, 0)]


# 9 mixing


def test_targets():
    assert mixing.fill_targets([100, 100, 100], [5, 2, 1], 3) == pytest.approx([187.5, 75, 37.5])
    assert mixing.fill_targets([10, 100, 100], [5, 2, 1], 3) == pytest.approx([30, 120, 60])
    assert mixing.fill_targets([0, 5], [5, 2], 3) == [0, 5] and mixing.fill_targets([], [], 3) == []


def test_mix_meets_its_targets(real):
    rows = mixing.mix(real).collect()
    total, by = sum(r["size"] * r["copies"] for r in rows), defaultdict(list)
    for r in rows:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    assert sum(r["taken"] * r["copies"] for r in rows) <= total
    for found in by.values():
        assert abs(sum(r["taken"] * r["copies"] for r in found) - found[0]["target"]) <= 2 * max(r["size"] for r in found)
    assert sum(f[0]["target"] for f in by.values()) == pytest.approx(total)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(real.orderBy(F.desc("text")).repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_mix_of_edges(docs):
    rows = mixing.mix(docs).collect()
    assert sum(r["copies"] for r in rows) == len(TEXTS)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["taken"] // r["size"] * r["copies"] for r in rows if r["size"])


# 10 languages


def test_languages_of_held_out_documents(real):
    profiles = language.learn_profiles(language.training_rows(real))
    known = {r["doc_id"]: r["lang"] for r in real.collect()}
    found = language.identify(real, profiles).collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_languages_of_edges(docs):
    profiles = language.learn_profiles(docs.select("lang", "text"))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, profiles).collect()}
    assert [got[i] for i in (3, 4, 5, 6)] == ["und"] * 4 and got[9] == "de" and got[1] == "en" and got[7] == "fr"
    kept = language.with_language(docs, profiles)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 4


def test_without_labels_texts_with_letters_stay(spark):
    frame = spark.createDataFrame([(1, None, "words of a language"), (2, None, "12345 !!!"), (3, None, None), (4, None, ""), (5, None, "\u00dcber")], "doc_id long, lang string, text string")
    kept = language.with_language(frame, language.learn_profiles(language.training_rows(frame)))
    assert {r["doc_id"] for r in kept.collect()} == {1, 5}


def test_profile_distance_is_out_of_place():
    model = language.Profiles({"x": language.grams(language.letter_codes("ab"))[:3], "y": language.grams(language.letter_codes("cd"))[:3]})
    assert model.best("ab")[0] == "x" and model.best("cd")[0] == "y" and model.best("ab")[1] > model.best("zq")[1]
