import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions import titles as H
from corpuscle.functions.wikitext import Link, parse_page


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "t string").select(*cols).first()


def test_titles(spark):
    t = F.col("t")
    assert one(spark, "yokohama_station", H.normalize_title(t))[0] == "Yokohama station"
    assert one(spark, "", H.normalize_title(t))[0] == ""
    assert one(spark, "Category:x", H.is_category_title(t, "en"))[0] and one(spark, "カテゴリ:x", H.is_category_title(t, "ja"))[0]
    assert not one(spark, "カテゴリ:x", H.is_category_title(t, "en"))[0]
    assert one(spark, "file:x", H.is_media_title(t, "de"))[0] and one(spark, "Datei:x", H.is_media_title(t, "de"))[0]
    assert one(spark, "Mercury (planet)", H.strip_disambiguator(t))[0] == "Mercury"
    assert one(spark, "'''a''' ''b'' c'd", H.strip_quote_markup(t))[0] == "a b c'd"


@pytest.mark.parametrize(("text", "flag"), [("Text", False), ("{{disambig}}", True), ("{{ disambig | arg }}", True), ("{{   aimai   | arg1 | arg2 }}", True), ("{{Infobox|disambig}}", False), (None, False)])
def test_disambiguation(spark, text, flag):
    assert one(spark, text, H.is_disambiguation(F.col("t")))[0] is flag


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Kyoto was an old seat of power"), (2, "😀 a½_b, ß!"), (3, ""), (4, None), (5, "...")], "id int, text string")
    rows = {}
    for r in T.regexp_tokens(df, ["id"]).orderBy("id", "pos").collect():
        rows.setdefault(r.id, []).append((r.token, r.start, r.end))
    assert [(a, b) for _, a, b in rows[1]] == [(0, 5), (6, 9), (10, 12), (13, 16), (17, 21), (22, 24), (25, 30)]
    assert rows[2] == [("a½_b", 2, 6), ("ß", 8, 9)] and set(rows) == {1, 2}


def test_python_tokenizer(spark):
    tok = T.PythonTokenizer(lambda t: [(c, i, i + 1) for i, c in enumerate(t)])
    assert [r.token for r in tok.tokens(spark.createDataFrame([(1, "ab")], "id int, text string"), ["id"]).collect()] == ["a", "b"]
    assert one(spark, "ab", tok.words(F.col("t")))[0] == ["a", "b"]


def test_registry():
    assert isinstance(T.get_tokenizer("regexp"), T.Tokenizer) and isinstance(T.get_default_tokenizer("en"), T.Tokenizer)
    with pytest.raises(NotImplementedError):
        T.get_tokenizer("other")
    with pytest.raises(RuntimeError):
        T.get_tokenizer("jieba", "zh")
    with pytest.raises(NotImplementedError):
        T.get_sentence_detector("other")
    assert T.get_sentence_detector("icu") is T.sentences


def test_sentences(spark):
    text = "One is here. Two is \"there!\"  Three"
    rows = T.sentences(spark.createDataFrame([(1, text), (2, "")], "id int, text string"), ["id"]).orderBy("sent").collect()
    assert [text[r.start : r.end] for r in rows] == ["One is here. ", "Two is \"there!\"  ", "Three"]


def test_normalize_text(spark):
    assert one(spark, "Ünïcode  \n ÇA", T.normalize_text(F.col("t")))[0] == "unicode ca"
    assert one(spark, None, T.normalize_text(F.col("t")))[0] is None


def test_parse_links():
    p = parse_page("'''Peru''' lies on the [[Pacific Ocean|Pacific]], a [[large country|big land]] of <i>[[South America]]</i>")
    text = "Peru lies on the Pacific, a big land of South America"
    assert len(p) == 1 and p[0].text == text and p[0].abstract
    want = [("Pacific Ocean", "Pacific"), ("Large country", "big land"), ("South America", "South America")]
    assert p[0].links == [Link(title, shown, text.index(shown), text.index(shown) + len(shown)) for title, shown in want]


def test_parse_categories_and_media():
    for markup, shown in (("[[Category:Rivers]]", "Rivers"), ("[[Category:Rivers|Long rivers]]", "Long rivers")):
        (p,) = parse_page(markup)
        assert p.text == shown and [tuple(k) for k in p.links] == [("Category:Rivers", shown, 0, len(shown))]
    p = parse_page("[[File:a.ogg]] and [[Image:b.png|shown]]")
    assert p[0].text == " and " and p[0].links == []
    assert parse_page("[[Datei:a.png|mini|[[x]] y]]z", "de")[0].text == "z"


def test_parse_markup():
    text = "{{Infobox|a=[[x]]|b={{c}}}}lead <ref name=a>no [[r]]</ref>text<ref name=b/> &amp; more<!-- c -->\n{| class=x\n|-\n| [[y]]\n|}\n== Head ==\nbody [[a_b#c|''d'']] [http://x.y label] <nowiki>[[n]]</nowiki>\n=== Empty ===\n"
    p = parse_page(text)
    assert [x.abstract for x in p] == [True, False, False]
    assert p[0].text.strip() == "lead text & more" and p[1].links[0].title == "A b#c" and "[[n]]" in p[1].text and "label" in p[1].text
    for x in p:
        assert all(x.text[k.start : k.end] == k.text for k in x.links)
    assert parse_page("[[:Category:X|y]]")[0].links[0].title == "Category:X" and parse_page("[[|z]]")[0].links == []
    for broken in ("[[", "[[a|", "{{", "{|", "<ref>", "<!--", "]]}}|}", "[[a]] [[b", "<b", "=a", "[[[[a]]]]"):
        parse_page(broken)
    assert parse_page("abc", preprocess=str.upper)[0].text == "ABC"


def test_wikitext_time_follows_length():
    """Markup that never closes is read once, however much of it there is."""
    import time

    from corpuscle.functions.wikitext import parse_page

    for piece in ("{{ a ", "[[ a ", "{{{ a ", "{| a ", "{", "[", "<ref>a", "<nowiki>", "<gallery>", "[http://a ", "<!--", "== "):
        start = time.process_time()
        parse_page(piece * 20_000)
        assert time.process_time() - start < 3, piece


def test_wikitext_pairs_are_those_of_counting():
    import random

    from corpuscle.functions.wikitext import _Pairs

    def count(text, at, opening, closing):
        depth = 0
        while at < len(text):
            if text.startswith(opening, at):
                depth, at = depth + 1, at + 2
            elif text.startswith(closing, at):
                depth, at = depth - 1, at + 2
                if not depth:
                    return at
            else:
                at += 1
        return -1

    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("{}[]|a") for _ in range(rng.randrange(1, 25)))
        pairs = _Pairs(text)
        for a, b in (("{{", "}}"), ("[[", "]]"), ("{|", "|}")):
            assert all(pairs.end(i, a, b) == count(text, i, a, b) for i in range(len(text)) if text.startswith(a, i))
