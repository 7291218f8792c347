import random

import numpy as np
import pytest

from quernel.llm import leakage
from quernel.llm.leakage import find, longest_run
from quernel.llm.reading import fold, reading_order

RND = random.Random(5)
VOCABULARY = ["".join(RND.choice("bdeghiklmnoprstu") for _ in range(RND.randint(3, 9))) for _ in range(900)]


def words(n):
    return [RND.choice(VOCABULARY) for _ in range(n)]


ITEM = words(60)
BOXES = "doc_id long, line_no int, x0 int, y0 int, x1 int, y1 int"


def lines_of(ws, per=6):
    return [" ".join(ws[i : i + per]) for i in range(0, len(ws), per)]


def folded(lines):
    return [[(fold(w), w) for w in line.split()] for line in lines]


def run(lines):
    return longest_run([fold(w) for w in ITEM], folded(lines))


def test_runs():
    assert run(lines_of(words(30) + ITEM[10:30] + words(30))) in (20, 21, 22)
    assert run(lines_of(words(200))) < 8
    assert run(lines_of(ITEM[:8] + words(1) + ITEM[9:16])) < 15


def test_run_over_set_in_lines_broken_and_joined_words():
    assert run([*lines_of(ITEM[:12]), "WANTED a steady man for round", "Apply Mill Street", *lines_of(ITEM[12:24])]) >= 24
    a, b = ITEM[5][:2], ITEM[5][2:]
    assert run([" ".join(ITEM[:5]) + " " + a + "-", b + " " + " ".join(ITEM[6:20])]) >= 20
    assert run([" ".join(ITEM[:5]) + " " + a, b + " " + " ".join(ITEM[6:20])]) >= 20
    assert run([" ".join(ITEM[:5]) + " " + ITEM[5] + ITEM[6] + " " + " ".join(ITEM[7:20])]) >= 20


def test_misread_words():
    noisy = [w.replace("e", "c").replace("h", "b") if i % 3 == 0 else w.replace("m", "rn") for i, w in enumerate(ITEM[:25])]
    assert run(lines_of(noisy)) >= 25


def test_short_misread_words():
    # Page 2271 and item 203 of the 0.1 tables.
    item = "Some sixty sawyers from Rothby sketched the condemned hospital parish school, although the timber of the condemned bridge was found to be rotten."
    page = ["Some sixty sawyers from R0tlby", "sketched fhe condemned bospital", "parish school, although the", "timber of the condemned bridge", "wasfound Mr Dunlgar, the former"]
    folds = [fold(w) for w in item.split()]
    assert longest_run(folds, folded(page)) == 20
    assert longest_run(folds, folded([*page[:3], "timber of fhe"])) == 15  # nothing follows the last one
    assert longest_run(folds, folded([page[0], "sketched many condemned bospital", *page[2:]])) == 13


def test_reading_order_of_columns():
    left, right = ["aaaa bbbb cccc", "dddd eeee ffff", "gggg hhhh iiii"], ["1111 2222 3333", "4444 5555 6666", "7777 8888 9999"]
    text = "\n".join([f"{left[0]}  {right[0]}", left[1], right[1], f"{left[2]} {right[2]}", "jjjj kkkk llll", "0000 1212 1313"])
    boxes = np.array([[1, 0, 0, 340, 9], [2, 0, 10, 140, 19], [3, 200, 10, 340, 19], [4, 0, 20, 340, 29], [4, 0, 20, 340, 29], [5, 140, 30, 0, 39], [6, 200, 30, 340, 39]])
    assert reading_order(text, boxes) == [*left, "jjjj kkkk llll", *right, "0000 1212 1313"]
    assert reading_order("a\nb", None) == ["a", "b"]
    lost = boxes[boxes[:, 0] != 5]
    assert reading_order(text, lost) == [*left, "jjjj kkkk llll", *right, "0000 1212 1313"]


@pytest.mark.parametrize("block", [leakage.BLOCK_CHARS, 500])
def test_query(spark, monkeypatch, block):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", block)
    items = [(k, " ".join(words(50))) for k in range(12)] + [(90, None), (91, ""), (92, "too short to leak")]
    leak = items[3][1].split()
    pages = [(1, "\n".join(lines_of(words(100) + leak[5:25] + words(90)))), (2, "\n".join(lines_of(words(300)))), (3, None), (4, ""), (5, "\n".join(lines_of(leak[:12] + words(50)))),
             (6, " ".join(words(9000) + leak[20:40] + words(50))), (1, "\n".join(lines_of(words(100) + leak[5:25] + words(90)))), (7, "\n".join(lines_of(leak)))]
    df = spark.createDataFrame(pages, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as line_no")
    boxes = spark.createDataFrame([(7, 1, None, 5, 9, 9), (8, 1, 1, 1, 1, 1), (None, 1, 1, 1, 1, 1)], BOXES)
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as doc_id")
    got = sorted(tuple(r) for r in find(df, "doc_id", "text", boxes, it, "item_id", "text").collect())
    assert got == [(1, 3), (6, 3), (7, 3)]
    assert find(df.limit(0), "doc_id", "text", boxes, it, "item_id", "text").collect() == []
    assert find(df, "doc_id", "text", boxes.limit(0), it.limit(0), "item_id", "text").collect() == []


def test_candidates_against_all_pairs():
    """Bands, bits and sliding sums find what an exhaustive count of shingles finds, and nothing else."""
    rnd = random.Random(11)
    few = VOCABULARY[:60]  # so that items share many shingles
    texts = [" ".join(rnd.choice(few) if rnd.random() < 0.7 else rnd.choice(VOCABULARY) for _ in range(rnd.randint(10, 70))) for _ in range(80)]
    items = leakage.Items(list(enumerate(texts)))
    hashes = leakage.Hashes()
    words_, ends = [], []
    for _ in range(300):
        page = [rnd.choice(few) for _ in range(rnd.randint(0, 60))]
        source = rnd.choice(texts).split()
        a = rnd.randint(0, max(0, len(source) - 16))
        page += [w if rnd.random() > 0.06 else rnd.choice(VOCABULARY) for w in source[a : a + 25]] + [rnd.choice(few) for _ in range(rnd.randint(1, 60))]
        words_ += page
        ends.append(len(words_))
    h = leakage._hashed(words_, hashes)
    places, begins, sizes, firsts = leakage._windows(h, np.array(ends), items)
    window, item = items.candidates(places, begins, sizes)
    found = set(zip(window.tolist(), item.tolist()))
    exact = set()
    for w, (b, n) in enumerate(zip(begins.tolist(), sizes.tolist())):
        held = set(places[b : b + n].tolist())
        for i, (s, k) in enumerate(zip(items.starts.tolist(), items.lengths.tolist())):
            own = [p in held for p in items.places[s : s + k].tolist()]
            if any(sum(own[j : j + leakage.SPAN]) >= leakage.NEEDED for j in range(k - leakage.SPAN + 1)):
                exact.add((w, i))
    assert len(exact) > 150 and found <= exact and len(found) >= 0.98 * len(exact)
    edges = [0, *ends]
    assert all(any(a <= f < z for a, z in zip(edges, edges[1:])) for f in firsts.tolist())


def test_longer_texts_between():
    advert = ["WANTED a steady man"] * leakage.SET_IN
    assert run([*lines_of(ITEM[:12]), *advert, *lines_of(ITEM[12:24])]) >= 24
    assert run([*lines_of(ITEM[:12]), *advert, advert[0], *lines_of(ITEM[12:24])]) < 15


def test_pages_of_a_batch_are_kept_apart():
    items = leakage.Items([(1, " ".join(ITEM))])
    halves = [(1, " ".join(ITEM[:12]), None), (2, " ".join(ITEM[12:24]), None), (3, "", None), (4, "- -- |", None), (5, " ".join(ITEM[:16]), None)]
    assert leakage.leaks(halves, items, leakage.Hashes(), leakage.Folds()) == [(5, 1)]
    assert leakage.leaks(halves, leakage.Items([]), leakage.Hashes(), leakage.Folds()) == []
    assert leakage.leaks([(9, "ab cd", None)], items, leakage.Hashes(), leakage.Folds()) == []
