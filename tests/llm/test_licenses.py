"""Patience alignment and license spans."""

import random

import pytest

from tickloom.llm import licenses
from tickloom.llm.common import read_table


def test_longest_run():
    assert licenses.longest_run([]) == []
    assert licenses.longest_run([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]


def test_pairs_are_equal_words_in_order():
    rng = random.Random(2)
    for _ in range(200):
        left = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))]
        right = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))]
        pairs = licenses.patience(left, right)
        assert all(left[i] == right[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
    same = list("abcabc")
    assert licenses.patience(same, same) == [(i, i) for i in range(6)]


def test_planted_licenses(spark):
    rng = random.Random(1)
    filler = ["the", "of", "software", "license", "under", "and", "to", "word"]
    rows, wanted = [], set()
    for d, (name, text) in enumerate(licenses.TEMPLATES.items()):
        words = text.split()
        if len(words) > 20:
            for _ in range(len(words) // 12):
                words[rng.randrange(len(words))] = "changed"
        noise = " ".join(rng.choice(filler) for _ in range(30))
        rows.append((d, f"{noise}. {' '.join(words)} {noise}. {' '.join(words)}"))
        wanted |= {(d, name, 2)}
    rows += [(100, None), (101, ""), (None, "Released under the MIT License."), (102, " ".join(filler * 20))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    found = licenses.license_spans(docs).collect()
    counts = {}
    for r in found:
        counts[(r.doc_id, r.license)] = counts.get((r.doc_id, r.license), 0) + 1
        assert r.coverage >= 0.8 and r.end_word > r.first_word
    assert wanted <= {(*k, n) for k, n in counts.items()}
    assert (None, "MIT-notice") in counts and not {100, 101, 102} & {d for d, _ in counts}
    assert licenses.license_spans(docs.limit(0)).count() == 0


def test_every_notice_of_the_documents_is_found(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    found = {(r.doc_id, r.license) for r in licenses.license_spans(docs).collect()}
    notices = {n: t for n, t in licenses.TEMPLATES.items() if n.endswith("-notice")}
    planted = {(r.doc_id, n) for r in docs.collect() for n, t in notices.items() if t in r.text}
    assert planted <= found and len(planted) > 10
    assert {d for d, _ in found} == {d for d, _ in planted}


@pytest.mark.parametrize("gap", range(9))
@pytest.mark.parametrize("copies", [2, 3])
def test_copies_side_by_side_are_all_found(gap, copies):
    """Short and long templates, in prose, with few words between the copies."""
    rng = random.Random(gap)
    for name in ("MIT-notice", "CC-BY-4.0", "BSD-3-Clause-endorsement", "MIT"):
        words = licenses.words_of(licenses.TEMPLATES[name])
        search = licenses.LicenseSearch({name: licenses.TEMPLATES[name]}, 0.8)
        for prose in (0, 1, 40):
            noise = lambda n: [rng.choice(["the", "of", "software", "license", "under", "plain"]) for _ in range(n)]
            text, wanted = noise(prose), []
            for _ in range(copies):
                wanted.append((len(text), len(text) + len(words)))
                text = text + words + [f"gap{i}" for i in range(gap)]
            text += noise(prose)
            hits = sorted(search.found(" ".join(text)), key=lambda h: h[3])
            assert len(hits) == copies, (name, gap, prose)
            for (_, coverage, _, first, last), (start, end) in zip(hits, wanted):
                assert coverage >= 0.8 and first < end and last > start


def common_length(left, right):
    """Longest common subsequence by the plain table."""
    row = [0] * (len(right) + 1)
    for a in left:
        above = row[:]
        for j, b in enumerate(right):
            row[j + 1] = above[j] + 1 if a == b else max(row[j], above[j + 1])
    return row[-1]


def test_hits_against_a_plain_aligner():
    """What is reported is covered by the plain alignment too; where that covers nowhere enough, nothing is reported."""
    rng = random.Random(9)
    template = "one two three two four five six seven eight nine ten one"
    words, search = template.split(), licenses.LicenseSearch({"t": template}, 0.8)
    for _ in range(300):
        text = [rng.choice([*words, "x", "y"]) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            copy = [w if rng.random() > 0.12 else "z" for w in words]
            at = rng.randrange(len(text) + 1)
            text = text[:at] + copy + text[at:]
        hits = search.found(" ".join(text))
        for _, coverage, n, first, last in hits:
            assert n <= common_length(words, text[first:last]) and n == round(coverage * len(words)) >= 0.8 * len(words)
        spans = sorted((h[3], h[4]) for h in hits)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        whole = [i for i in range(len(text) - len(words) + 1) if text[i : i + len(words)] == words]
        assert all(any(first < i + len(words) and last > i for first, last in spans) for i in whole)
        if common_length(words, text) < 0.8 * len(words):
            assert not hits
