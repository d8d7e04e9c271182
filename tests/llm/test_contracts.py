"""The opN_ queries and the pipeline as a whole: against plain versions on a table of edges, and on ids that no double holds."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import LOWER, WORD, components_by_force, removed_by_force

import corpus_pipeline
from tidelog.llm import ann, bpe, common, ctw, html, jaccard, language, lines, mixing, queries, repeats, topk

BIG = (1 << 60) + 1
SENTENCE = "the quick brown fox jumps over the lazy dog and runs far away from here today"


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    """Small tables with nulls, empties, repeated rows, ties, large ids and a column that clashes."""
    d = str(tmp_path_factory.mktemp("edges"))
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i, t in enumerate(texts)]
    rows += [(BIG, SENTENCE, "en", "a"), (BIG + 2, SENTENCE, "en", "b"), (None, SENTENCE + " once more", "en", "a"), (None, None, None, None), (90, "", "en", "a"), (91, None, "de", "c"), (92, " \n\t", None, "b"), (93, "12 !!", "en", "a"), (94, texts[0] + " x", "en", "a"), (94, texts[0] + " x", "en", "a"), (95, "Ünïcode täxt " * 30, "de", "b")]
    write(spark, d, "documents", [(*r, "mine", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, bucket string, n_chars long")
    vecs = [(i - 100, [rng.gauss(0, 1) for _ in range(8)]) for i in range(0, 300)] + [(BIG, [1.0] * 8), (1000, None), (1001, [float("nan")] * 8), (1002, [0.0] * 8), (1003, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0])]
    write(spark, d, "embeddings", vecs, "vec_id long, embedding array<float>")
    page = "<html><body><nav><a>m</a></nav><article><h1>T{0}</h1><p>Body {0} with words</p></article><footer>f</footer></body></html>"
    write(spark, d, "pages", [(i, f"http://h{i % 3}/x", page.format(i)) for i in range(9)] + [(20, None, None), (21, "bad", ""), (None, "http://h0/z", page.format(7))], "page_id long, url string, html string")
    return d


def rows_of(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source").collect()


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 if i is not None else zlib.crc32(b"") % 5


def test_every_query_gives_its_columns_on_edges(spark, edge_dir):
    found = {name: f(spark, edge_dir) for name, f in queries.queries().items()}
    columns = {
        "op1_ctw_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op2_ann_search": ["query_id", "rank", "vec_id", "score"], "op4_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op5_extract_html": ["page_id", "url", "text", "n_chars"], "op6_topk_search": ["query_id", "rank", "vec_id", "score"], "op7_repeated_passages": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op8_jaccard_join": ["doc_id", "n_shingles", "component_id"], "op9_mix_sources": ["doc_id", "size", "source_size", "target", "taken"], "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    }
    for name, want in columns.items():
        assert found[name].columns[: len(want)] == want, name
    n = len(rows_of(spark, edge_dir))
    for name in ("op1_ctw_score", "op3_line_dedup", "op4_bpe", "op7_repeated_passages", "op8_jaccard_join", "op9_mix_sources", "op10_language_id"):
        assert found[name].count() == n, name
    kinds = dict(found["op1_ctw_score"].dtypes)
    assert kinds["held_out"] == "boolean" and kinds["train_tokens"] == "bigint" and kinds["score"] == "double"
    assert dict(found["op2_ann_search"].dtypes)["rank"] == "int" and dict(found["op6_topk_search"].dtypes)["score"] == "bigint"


def test_large_ids_beside_nulls_stay_what_they_are(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    for found in (ctw.op1_ctw_score(spark, edge_dir), repeats.op7_repeated_passages(spark, edge_dir)):
        assert Counter(r["doc_id"] for r in found.collect()) == Counter(r["doc_id"] for r in docs.collect())


def test_passages_against_force_with_null_ids(spark, edge_dir):
    rows = rows_of(spark, edge_dir)
    once = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}
    want = removed_by_force(once)
    for r in repeats.op7_repeated_passages(spark, edge_dir).collect():
        got = (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
        if r["doc_id"] is None:
            assert r["n_removed"] == 0 and r["n_spans"] == 0
        else:
            assert got == want[r["doc_id"]]


def test_base_score_and_held_out_of_the_query(spark, edge_dir):
    rows = rows_of(spark, edge_dir)
    words = lambda t: WORD.findall((t or "").translate(LOWER)) + ["\n"]
    counts = Counter(w for r in rows if fold(r["doc_id"]) != 1 for w in words(r["text"]))
    total, v = sum(counts.values()), len(counts)
    want = Counter((r["doc_id"], fold(r["doc_id"]) == 1, len(words(r["text"])), sum(w in counts for w in words(r["text"])), total, round(sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (v + 1))) for w in words(r["text"])), 6)) for r in rows)
    got = ctw.op1_ctw_score(spark, edge_dir).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_join_against_force(spark, edge_dir):
    rows = rows_of(spark, edge_dir)
    want = components_by_force({r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None})
    for r in jaccard.op8_jaccard_join(spark, edge_dir).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] if r["doc_id"] is not None else r["component_id"] is None


def test_repeated_ids_with_other_texts_and_identical_rows(spark):
    rows = [(2, "ccc\naaa"), (2, "ddd\neee"), (1, "aaa"), (5, "same\nline"), (5, "same\nline"), (6, None), (6, None)]
    got = sorted((r["doc_id"], r["text"] or "") for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "aaa"), (2, "ccc"), (2, "ddd\neee"), (5, ""), (5, "same\nline"), (6, ""), (6, "")]


def mix_by_force(rows, targets, cap=3):
    """A plain queue: every source sends its documents in hash order, again and again, and the smallest finish times win until the budget is spent."""
    turns = []
    for source, docs in rows.items():
        sent = 0
        for again in range(cap):
            for h, doc, size, copies in docs:
                sent += size * copies
                if targets[source] and sent / targets[source] < 2:
                    turns.append((sent / targets[source], source, h, doc, size, copies))
    left, taken = sum(size * copies for docs in rows.values() for _, _, size, copies in docs), Counter()
    for _, source, _, doc, size, copies in sorted(turns, key=lambda t: (t[0], t[1], t[2], (t[3] is not None, t[3] or 0), t[4])):
        if size * copies > left:
            break
        left -= size * copies
        taken[source, doc, size] += size
    return taken


def test_mix_equals_a_plain_queue(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    got = mixing.mix(docs).withColumn("hash", F.xxhash64("doc_id", F.lit(17))).collect()
    ranks = {s: i for i, s in enumerate(sorted({r["source"] for r in got}, key=lambda s: (s is None, s or "")))}
    sizes = {s: sum(r["size"] * r["copies"] for r in got if r["source"] == s) for s in ranks}
    counted = Counter()
    for r in docs.collect():
        counted[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert {s: n for s, n in sizes.items()} == {s: counted[s] for s in sizes}
    targets = {ranks[s]: {r["target"] for r in got if r["source"] == s}.pop() for s in ranks}
    queue = {ranks[s]: sorted(((r["hash"] >> 40) & 0xFFFFFF, r["hash"], (r["doc_id"] is not None, r["doc_id"] or 0), r["size"], r["doc_id"], r["copies"]) for r in got if r["source"] == s) for s in ranks}
    want = mix_by_force({s: [(q[1], q[4], q[3], q[5]) for q in rows] for s, rows in queue.items()}, targets)
    assert {(ranks[r["source"]], r["doc_id"], r["size"]): r["taken"] for r in got if r["taken"]} == {k: v for k, v in want.items() if v}


def grams_of(text):
    """1- to 3-grams of letters in lower case, a blank at both ends and between runs of letters."""
    letters = [c if c.isalpha() else " " for c in " " + text.lower() + " "]
    squeezed = re.sub(" +", " ", "".join(letters))
    return Counter(g for k in (1, 2, 3) for g in (squeezed[i : i + k] for i in range(len(squeezed) - k + 1)) if g.strip())


def ranked(counts, size):
    # equal counts go by code points, a blank counting 1 and shorter n-grams first
    key = lambda g: sum((1 if c == " " else ord(c)) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], key(g)))[:size]


def test_language_equals_plain_out_of_place(spark, edge_dir):
    rows = rows_of(spark, edge_dir)
    learned = {}
    for r in rows:
        if fold(r["doc_id"]) != 0 and r["lang"] is not None and r["text"]:
            learned.setdefault(r["lang"], Counter()).update(grams_of(r["text"]))
    merge = lambda c: Counter({g: n for g, n in c.items()})
    profiles = {lang: {g: i for i, g in enumerate(ranked(merge(c), language.PROFILE))} for lang, c in learned.items()}

    def best(text):
        mine = ranked(grams_of(text or ""), language.PROFILE)
        if not mine:
            return "und"
        apart = {lang: sum(abs(p[g] - i) if g in p else language.PROFILE for i, g in enumerate(mine)) for lang, p in profiles.items()}
        return min(sorted(apart), key=apart.get)

    got = language.op10_language_id(spark, edge_dir).collect()
    assert Counter((r["doc_id"], r["held_out"], r["lang_pred"]) for r in got) == Counter((r["doc_id"], fold(r["doc_id"]) == 0, best(r["text"])) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_bpe_query_against_the_library(spark, edge_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())

    def digest(t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    want = Counter((r["doc_id"], *digest(r["text"])) for r in rows_of(spark, edge_dir))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op4_bpe(spark, edge_dir).collect()) == want


def test_searches_take_every_query(spark, edge_dir):
    usable = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{edge_dir}/embeddings.parquet").collect() if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"])}
    ints = {i: np.floor(256 * v).astype(np.int64) for i, v in usable.items()}
    got = {}
    for r in topk.op6_topk_search(spark, edge_dir).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {i for i in ints if i % 50 == 0}
    for q, found in got.items():
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        assert [found[k] for k in sorted(found)] == [(i, -s) for s, i in best]
    nonzero = {i: v for i, v in usable.items() if v.any()}
    near = {}
    for r in ann.op2_ann_search(spark, edge_dir).collect():
        near.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(near) == {i for i in nonzero if i % 100 == 0}
    for q, found in near.items():
        assert len(found) == 10 and all(abs(s - np.linalg.norm(nonzero[q] - nonzero[i])) < 1e-9 for _, i, s in found)


def test_pages_long_deep_and_without_landmarks(spark):
    assert html.main_text("<div>" * 5000 + "hello" + "</div>" * 5000) == "hello"
    assert html.main_text("<a " * 350_000).startswith("<a <a")
    rng = random.Random(1)
    body = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(40))
    rows, want = [], {}
    for i in range(12):
        paragraphs = [body() for _ in range(3)]
        rows.append((i, "http://plain.example/x", f"<html><body><div class='top'>Shop</div><ul><li>a{i}</li><li>b</li></ul><div class='c1'><p class='alert'>{paragraphs[0]}</p><div class='share-of-market'>{paragraphs[1]}</div><p>We are the best shop</p><p>{paragraphs[2]}</p></div><div class='side'>News {i}</div></body></html>"))
        want[i] = "\n\n".join(paragraphs)
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(seed + 1)).collect()}
        assert got == want
    a, b, c = (html.folded(html.tree(r[2])) for r in rows[:3])
    assert html.aligned(html.aligned(a, b), c) == html.aligned(a, html.aligned(b, c)) == html.aligned(html.aligned(c, a), b)


def test_pipeline_runs_on_edges_and_on_nothing(spark, edge_dir, tmp_path):
    rows = rows_of(spark, edge_dir)
    found = corpus_pipeline.run(spark, edge_dir)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = {r["doc_id"] for r in found.collect()}
    assert ids and ids <= {r["doc_id"] for r in rows} and not ids & {90, 91, 92, 93}
    write(spark, str(tmp_path), "documents", [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://there:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="share"):
        common._shared_folder(Session())
