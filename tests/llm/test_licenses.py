"""License scans against brute force: base phrases, names, notices with changed words, odd tables."""

import random
import re

from orbitlake.llm import licenses


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(t, phrases):
    w = words(t)
    hits = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits}))


def texts():
    rng = random.Random(3)
    vocab = "gnu general public license apache cc by mit nc sa bsd 2 3 clause é the of".split()
    notice = next(iter(licenses.NOTICES))
    changed = notice.replace("free of charge", "without any charge").replace("merge, publish, distribute", "merge or give").replace("associated ", "")
    return [*(" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(40)), None, "", "...", "MIT License-CC_by", "mit license " * 20_000, "x " * 40 + notice, changed, notice[:90], "Mit", "x MIT"]


def test_base_phrases_and_names(spark, tmp_path):
    rows = [(i if i != 4 else None, t, "clash", 1, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, h int, template string")
    docs = docs.union(docs.where("doc_id = 2"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = licenses.op3_licenses(spark, str(tmp_path))
    assert out.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    found = out.collect()
    assert len(found) == len(rows) + 1
    for r in found:
        t = texts()[4 if r["doc_id"] is None else r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t, licenses.BASE)
        names = set(brute(t, licenses.BASE | licenses.NAMES)[4].split(",")) - {""}
        noticed = set(r["labels"].split(",")) - {""}
        assert names <= noticed and (names == noticed or "hereby" in t) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in found}
    whole, changed, part = (next(i for i, t in enumerate(texts()) if t and t.startswith(x)) for x in ("x x", "Permission is hereby granted, without", "Permission is hereby granted, free"))
    assert by[whole]["labels"] == "mit" and by[whole]["score"] == 1 and by[changed]["labels"] == "mit" and 0.5 < by[changed]["score"] < 1 and by[part]["labels"] == ""
    assert licenses.scan(docs.limit(0)).count() == 0


def test_spans(spark):
    notice = next(iter(licenses.NOTICES))
    docs = spark.createDataFrame([(1, "a b c " + notice + " d e f " + notice)], "doc_id long, text string")
    spans = sorted((r["start"], r["end"]) for r in licenses.spans(docs)[1].where("kind = 'notice'").collect())
    n = len(words(notice))
    assert len(spans) >= 1 and spans[0][0] == 3 and spans[-1][1] == 2 * n + 6
