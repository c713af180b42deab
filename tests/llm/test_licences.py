"""License scans against plain programming."""

import random
import re

from sparkloom.llm import licences
from sparkloom.llm.licences import LEAST_MATCH, MOST_GAP, PHRASES, TEMPLATES

from .util import clashing, docs, empty, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text):
    w = words(text)
    found = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def longest(w, texts):
    """For each end in w, the longest run of words up to it that stands in a text, by trying all."""
    grams = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    return [next((n for n in range(end, 0, -1) if tuple(w[end - n : end]) in grams), 0) for end in range(1, len(w) + 1)]


def test_matching_statistics_and_places_equal_trying_all():
    rng = random.Random(2)
    for _ in range(40):
        letters = "abc" if rng.random() < 0.5 else "abcdefg"
        templates = {f"t{i}": (" ".join(rng.choices(letters, k=rng.randint(4, 12))),) for i in range(3)}
        automaton = licences.LicenceAutomaton(templates, {"a b": "x", "c": "y"}, 2)
        w = rng.choices(letters + "z", k=60)
        n, places, matches = automaton.scan(iter([[x.encode() for x in w[:31]], [x.encode() for x in w[31:]]]))
        assert n == 60
        assert sorted(places) == sorted([(i, "x") for i in range(59) if w[i : i + 2] == ["a", "b"]] + [(i, "y") for i in range(60) if w[i] == "c"])
        texts = [t.split() for (t,) in templates.values()] + [["a", "b"], ["c"]]
        best = [*longest(w, texts), 0]
        want = {(i + 1, best[i]) for i in range(60) if best[i] >= 2 and best[i + 1] <= best[i]}
        assert {(end, size) for end, size, _ in matches} == want
        for end, size, s in matches:
            run = w[end - size : end]
            want = sorted((k, j) for k, (t,) in enumerate(templates.values()) for j in range(size, len(t.split()) + 1) if t.split()[j - size : j] == run)
            assert sorted(automaton.ends.get(s, [])) == want


def brute_chain(automaton, matches, k, gap):
    """The most words of template k that a chain covers, over all chains."""
    anchors = sorted((end, there, n) for end, n, s in matches for kk, there in automaton.ends.get(s, []) if kk == k)

    def from_(i):
        end, there, n = anchors[i]
        return max([0, *(min(m, e - end, t - there) + from_(j) for j, (e, t, m) in enumerate(anchors) if e > end and t > there and e - m - end <= gap)])

    return max((anchors[i][2] + from_(i) for i in range(len(anchors))), default=0)


def test_chains_cover_what_the_best_of_all_chains_covers():
    rng = random.Random(4)
    for _ in range(30):
        text = [f"w{i}" for i in rng.choices(range(30), k=40)]
        automaton = licences.LicenceAutomaton({"t": (" ".join(text),)}, {}, 2)
        at, w = 0, []
        while at < 40:
            w += text[at : at + rng.randint(1, 9)] + ["filled"] * rng.choice([0, 1, 3, 9])
            at += rng.randint(1, 9)
        _, _, matches = automaton.scan(iter([[x.encode() for x in w]]))
        assert max((c[3] for c in automaton.chains(matches, 4)), default=0) == brute_chain(automaton, matches, 0, 4)


def test_licence_scan_of_texts(spark):
    rng = random.Random(7)
    mit, bsd = TEMPLATES["mit"][0], TEMPLATES["bsd"][0]
    filled = mit.replace("the above copyright", "the above (2019 Jane Doe) copyright").replace("of the Software, and to permit", "of the Software and its parts, and to permit")
    texts = [
        None, "", "!?", prose(rng, 200), "Released under the MIT License.", "mit-LICENSE apache license mit license", "general public, license general public", "The General Public License",
        prose(rng, 50) + " " + mit + " " + prose(rng, 50), filled.upper(), bsd.replace("copyright holder", "University of X"), " ".join(mit.split()[:20]), "Licensed under CC BY-NC 4.0.",
        "licensed under cc by 4.0 mit license", "İ MIT License", prose(rng, 200_000) + " mit license " + mit + " " + prose(rng, 200_000), "word" * 700_000 + " apache license",
    ]
    texts += texts[:6]
    got = licences.scan_licences(clashing(docs(spark, texts)).repartition(4)).collect()
    found = {r.doc_id: r for r in got}
    assert len(got) == len(texts)
    for i, text in enumerate(texts, 1):
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and r.labels.split(",") == sorted(set(r.labels.split(",")))
        assert 0 <= r.score <= 1 and all(0 <= s.first_word < s.end_word <= r.n_words for s in r.spans)
    labels = [found[i].labels for i in range(1, 18)]
    assert labels == ["", "", "", "", "mit", "apache,mit", "gpl", "gpl", "mit", "mit", "bsd", "", "cc-by-nc", "cc-by,mit", "mit", "mit", "apache"]
    assert found[9].score == 1 and [(s.first_word, s.end_word) for s in found[9].spans] == [(50, 50 + len(words(mit)))]
    assert 0.9 < found[10].score <= 1 and found[4].score == 0 and found[5].score == 0.5


def test_licence_scan_of_an_empty_table(spark):
    assert licences.scan_licences(empty(spark)).collect() == []


def test_licence_query_and_kept_columns(spark):
    d = "/root/testdata/sf0.001"
    rows = licences.op11_licences(spark, d).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
    kept = licences.scan_licences(docs(spark, ["MIT License", None]), keep=("doc_id", "text", "lang")).orderBy("doc_id").collect()
    assert [(r.text, r.labels) for r in kept] == [("MIT License", "mit"), (None, "")]
    assert LEAST_MATCH > 0 and MOST_GAP > 0
