"""op13: spans against edit distances of all spans of words, base places against lists of words, and edges."""

import random
import re

import pytest

from tidelog.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] if row[-1] <= most else -1


def spans_by_force(words, notices):
    out = {}
    starts = [i for i in range(len(words)) if (i == 0 or words[i - 1] == " ")] if words else []
    ends = [i for i in range(1, len(words) + 1) if i == len(words) or words[i] == " "] if words else []
    for n, (notice, _, k) in enumerate(notices):
        for a in starts:
            for b in ends:
                if a < b and abs(b - a - len(notice)) <= k and (d := distance(words[a:b], notice, k)) >= 0:
                    out[n, a, b] = d
    return out


def noisy(rng, phrase, edits):
    s = list(phrase)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(s))
        if kind == 0:
            s[at] = rng.choice("abcdeé ")
        elif kind == 1:
            s.insert(at, rng.choice("abcde "))
        elif len(s) > 1:
            del s[at]
    return "".join(s)


def some_texts():
    rng = random.Random(11)
    phrases = [n for n, _, _ in licenses.default_notices()]
    vocabulary = "the work is under a gnu license mit public cc by general apache licence of software ünï 3 clause".split()
    out = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(noisy(rng, rng.choice(phrases), rng.randint(0, 4)) if rng.random() < 0.6 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6))))
        out.append(rng.choice([" ", "  ", ", ", "\n-"]).join(parts))
    return out + ["CC BY CC-BY cc_by ccby", "MIT License" * 3, "GNU General Public License", "gnu general public license " * 3]


def test_spans_equal_edit_distances_of_all_spans():
    notices = licenses.default_notices()
    found = licenses.Finder(notices)
    total = 0
    for text in some_texts():
        words = licenses.plain_words(text)
        assert words == " ".join(WORD.findall(lower(text)))
        got = found.spans(words)
        assert got == spans_by_force(words, notices)
        total += sum(e > 0 for e in got.values())
    assert total > 50


def test_hits_do_not_overlap_and_are_the_best():
    notices = licenses.default_notices()
    found = licenses.Finder(notices)
    for text in some_texts():
        words = licenses.plain_words(text)
        spans = found.spans(words)
        want = []
        for i in {n for n, _, _ in spans}:
            taken = []
            for e, a, b in sorted((e, a, b) for (n, a, b), e in spans.items() if n == i):
                if all(b <= x or y <= a for x, y in taken):
                    taken.append((a, b))
                    want.append((a, b, i, e))
        got = found.hits(words, spans)
        assert [(h[4], h[5], h[6]) for h in got] == [(a, b, e) for a, b, _, e in sorted(want)]
        split = words.split(" ")
        assert all(" ".join(split[h[2] : h[2] + h[3]]) == words[h[4] : h[5]] for h in got)


def base_by_force(text):
    words = WORD.findall(lower(text or ""))
    places = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_query_on_edges(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(some_texts())] + [(1000, None), (1001, ""), (1002, " -,\n"), (None, "under the MIT License"), (5, "cc by"), (5, "cc by"), (1003, "word " * 200_000 + "CC-BY " * 1000)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, hits string, n_words int").write.parquet(str(tmp_path / "documents.parquet"))
    got = licenses.op13_license_scan(spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    key = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
    found = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got.collect()), key=key)
    assert found == sorted(((i, *base_by_force(t)) for i, t in rows), key=key)
    for r in got.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        assert r["score"] == (1 if r["n_base"] else r["score"]) and (r["score"] > 0) == bool(r["labels"])


def test_spans_in_the_text_as_it_came(spark):
    texts = ["Ünder the  GNU\n--General Public Licence!", "x", "see (MIT License), or the MIT Licence."]
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        for h in r["hits"]:
            assert licenses.plain_words(r["text"][h["start"] : h["end"]]).count(" ") + 1 == h["words"]
            assert distance(licenses.plain_words(r["text"][h["start"] : h["end"]]), h["notice"], 9) == h["edits"]
        if r["doc_id"] == 0:
            assert [(h["label"], h["edits"]) for h in r["hits"]] == [("gpl", 1)]
        assert (not r["hits"]) == (r["doc_id"] == 1)


def test_own_notices_and_refusals(spark):
    docs = spark.createDataFrame([(1, "all rights reserved by me")], "doc_id long, text string")
    assert licenses.scan(docs, (("all rights reserved", "reserved", 2),), ()).first()["hits"][0]["label"] == "reserved"
    assert licenses.scan(docs, (), ()).first()["hits"] == [] and licenses.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, (("all rights reserved", "r", 2),))
    for bad in ("", "Upper case", "two  blanks", " edge", "a-b"):
        with pytest.raises(ValueError):
            licenses.Finder([(bad, "x", 0)])
