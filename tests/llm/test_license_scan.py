import math
import random
import re

from glenfare.llm import license_scan as S
from helpers import SF, as_rows, clashing, documents, edge_docs, empty_docs

COLS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(doc_id, text):
    w = split(text)
    places, base = [], set()
    for phrase, label in S.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += own
        base |= {label} if own else set()
    labels, best = set(base), 1.0 if base else 0.0
    for line in (text or "").split("\n"):
        lw, size = split(line), S.BLOCK_WORDS
        parts = [lw] if len(lw) <= size else [lw[i:i + size] for i in range(0, len(lw) - size // 2, size // 2)]
        for label, t in S.TEMPLATES:
            own = set(split(t))
            for part in parts:
                shared = len(own & set(part))
                if shared >= math.ceil(S.CONTAINMENT * len(own) - 1e-9):
                    labels.add(label)
                    best = max(best, shared / len(own))
    return (doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), best)


def test_query_matches_brute_force(spark):
    got = as_rows(S.op9_license_scan(spark, SF), *COLS)
    assert got == sorted([brute(r["doc_id"], r["text"]) for r in documents(spark).collect()], key=repr)


def made_texts():
    rnd = random.Random(8)
    vocabulary = sorted({w for _, t in S.TEMPLATES for w in split(t)}) + ["filler", "words", "été", "x2"]
    out = ["Under the\nMIT license under the mit license", "cc by nc cc-by-nc CC  by\tnc", "apache license version 2.0 version 2",
           "Licensed under the GNU General Public\nLicense", "released under the license"]
    for label, t in S.TEMPLATES:
        words = t.split()
        rnd.shuffle(words)
        out.append(" ".join(words))
        out.append(" ".join(words[:-1]))
        out.append(" ".join(rnd.choices(["a", "lorem", "ipsum"], k=130)) + " " + t + " dolor" * 70)
    out += [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 200))) for _ in range(60)]
    return out


def test_join_is_exact(spark):
    rows = list(enumerate(made_texts()))
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(4)
    got = as_rows(S.license_rows(docs), *COLS)
    exp = sorted([brute(*r) for r in rows], key=repr)
    assert got == exp
    assert len({r[6] for r in exp}) > 8


def test_edges(spark):
    docs = edge_docs(spark)
    assert as_rows(S.license_rows(docs), *COLS) == sorted(
        [brute(r["doc_id"], r["text"]) for r in docs.collect()], key=repr)
    assert S.license_rows(empty_docs(spark)).count() == 0


def paragraph_brute(text):
    """Labels by brute force over the word sequence of each paragraph and of each line."""
    runs, size = [], S.BLOCK_WORDS
    paragraph = []
    for line in (text or "").split("\n") + [""]:
        w = split(line)
        runs.append(w)
        paragraph += w
        if not w:
            runs.append(paragraph)
            paragraph = []
    parts = [set(p) for r in runs for p in (
        [r] if len(r) <= size else [r[i:i + size] for i in range(0, len(r) - size // 2, size // 2)])]
    return {label for label, t in S.TEMPLATES for own in [set(split(t))]
            if any(len(own & p) >= math.ceil(S.CONTAINMENT * len(own) - 1e-9) for p in parts)}


def test_a_long_template_is_met_at_every_offset(spark):
    notice = " ".join(f"clause{k}" for k in range(90))
    rows = [(k, "filler " * k + notice + " filler" * 300) for k in range(0, 200, 7)] + [(1000, " ".join(notice.split()[:80]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["labels"] for r in S.license_rows(docs, [("long", notice), ("mit", "released under the MIT License")]).collect()}
    assert got == {k: "long" if k < 1000 else "" for k, _ in rows}
    assert S.window_words(S.TEMPLATES) == S.BLOCK_WORDS and S.window_words([]) == S.BLOCK_WORDS


def test_wrapped_notices(spark, tmp_path):
    rnd = random.Random(9)
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i:i + n]) for i in range(0, len(t.split()), n))
    rows = []
    for label, t in S.TEMPLATES:
        for n in (3, 5, 8):
            lead = " ".join(rnd.choices(["lorem", "ipsum"], k=rnd.randint(0, 150)))
            rows.append((label, wrap(f"{lead} {t} " + "dolor " * rnd.randint(0, 90), n)))
        rows.append((label, "# " + wrap(t, 4).replace("\n", "\n# ") + "\n#\n# sit amet"))
        w = t.split()
        rows.append((None, " ".join(w[:len(w) // 2]) + "\n\n" + " ".join(w[len(w) // 2:])))  # two paragraphs
    rows += [(None, r) for r in made_texts()]
    spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id bigint, text string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in S.op9_license_scan(spark, str(tmp_path)).collect()}
    for k, (label, t) in enumerate(rows):
        assert label is None or label in got[k], t
        assert got[k] == paragraph_brute(t) | set(filter(None, brute(k, t)[5].split(","))), t


def test_many_base_places_stay_linear():
    import time
    from glenfare.llm import license_scan
    took = []
    for n in (50_000, 200_000):  # the longer one is 4.6 MB
        flat = b"x under the mit license y".split() * n
        t0 = time.process_time()
        found = license_scan.base_places(flat, {"under the mit license": "mit"})
        took.append(time.process_time() - t0)
        assert found == {"mit": list(range(1, 6 * n, 6))}
    assert took[1] < 10 * took[0] + 0.5
