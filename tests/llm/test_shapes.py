import random

from quernel.llm.shapes import MOST, SHAPES, Words, judge, judge_pages, shapes

STORY = "The junior librarian of Old Brackwell insured the public harvest\nsupper early on Wednesday, and Mr Walumby feared that wages at\nthe tollgate turnpike had fallen since the constable left.\n"
LINKS = "Cheap hats: quickmart71.test\nwww.oldshop-corsets.test/gents/178\nhttp://hats.oldshop.example/?item=22\n"
TAGS = "BOOTS | cheap | no. 12 | 21/0 | #boots #cheap\nTEA | finest | no. 3 | 2/6 | #tea #finest\n"
CLOUD = "boots(46) twine(14) razors(65)\nkettles(52) soap(13) tea(80)\n"
KEYWORDS = "best cutlery Rothby, best cutlery\nStennis, best cutlery Upper Tolling,\n"
SONG = "Sing low, sing low, the tide is high\nand all the ships are home\n"
RESULTS = "Rothby 4, Aldmere 0; scorers Hill and Trent.\nThe match at Rothby drew Aldmere to the field.\n"


def flagged(text):
    words, listed, few = judge(text, Words())
    return listed > MOST * words and few <= SHAPES


def test_pages():
    for spam in (LINKS, TAGS, CLOUD, KEYWORDS):
        assert flagged(STORY + spam * 12)
        assert not flagged(STORY * 6 + spam)
    assert not flagged(SONG * 20) and not flagged(RESULTS * 12) and not flagged(STORY)
    assert flagged("\n".join(f"{a}  {b}" for a, b in zip((KEYWORDS * 9).split("\n"), (KEYWORDS * 9).split("\n"))))


def test_words_in_the_middle_of_long_texts_count():
    assert flagged(STORY + "word " * 3 + TAGS * 3000) and not flagged(TAGS + STORY * 3000)


def test_many_keywords_and_few_words():
    rnd = random.Random(4)
    keywords = ["".join(rnd.choice("bdfgklmprstvz") + rnd.choice("aeiou") for _ in range(4)) for _ in range(60)]
    stuffed = [k for k in keywords for _ in range(50)]
    for i in range(0, len(stuffed), 600):  # each keyword comes again within some hundred words
        part = stuffed[i : i + 600]
        rnd.shuffle(part)
        stuffed[i : i + 600] = part
    assert flagged("\n".join(" ".join(stuffed[i : i + 6]) for i in range(0, len(stuffed), 6)))
    assert flagged("cheap hats, cheap hats, cheap boots, cheap boots") and not flagged("cheap hats and boots")


def test_prose_of_a_language_without_any_list():
    italian = "Il vecchio sindaco di Bracciano ha detto che la riva del lago non è più\nsicura, ma chi vi abita da anni ne ha poca fede e va a vedere con gli altri.\n"
    assert not flagged(italian) and not flagged(italian * 30)
    assert flagged("cappelli nuovi Roma, cappelli nuovi\nPisa, cappelli nuovi Siena,\n" * 9)


def test_shapes_are_grouped():
    found = shapes(TAGS * 5 + STORY, Words())
    assert sum(found.values()) == len((TAGS * 5 + STORY).split()) and max(found.values()) >= 5 * 10 and len(found) <= 6


def test_query(spark):
    rows = [(1, KEYWORDS * 9), (2, None), (3, ""), (4, " \n\n "), (5, STORY), (1, KEYWORDS * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as words", "2 as id")
    got = sorted((r.doc_id, r.flagged) for r in judge_pages(df, "doc_id", "text").collect())
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False)]
    assert judge_pages(df.limit(0), "doc_id", "text").collect() == []
