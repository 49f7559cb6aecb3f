import hashlib
import re

from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.functions.porter import stem, with_stems
from trawl.functions.words import ENGLISH_LONG, ENGLISH_SHORT, HTML_WORDS

MARKUP = "The <p>Tesla's result</p> <a href=\"http://x.com\">link</a> was running"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_word_lists():
    assert (len(ENGLISH_SHORT), len(set(HTML_WORDS)), len(set(ENGLISH_LONG)), len({*HTML_WORDS, *ENGLISH_LONG})) == (33, 64, 111, 173)


def test_tokenizers(spark):
    assert one(spark, T.simple, MARKUP) == "the p tesla s result p a href http x com link a was running".split()
    assert one(spark, T.simple, None) == []
    assert one(spark, T.TOKENIZERS["nohtml_stop"], MARKUP) == "tesla s result x link running".split()
    assert one(spark, T.tokenizer(min_length=2), "a bb b ccc bb") == ["bb", "ccc", "bb"]
    assert one(spark, T.english, MARKUP) == "p tesla result p href http x com link running".split()


def test_forms(spark):
    page = "Head <b>x</b><p>Body &amp; more \x1c text&#39;s</p>"
    assert one(spark, T.stripped, page) == "Head x Body more text s"
    assert one(spark, T.title, page) == "Head <b>x</b>" and one(spark, T.title, "none") == "none"
    assert one(spark, T.body, page).startswith("<p>Body") and one(spark, T.body, "none") == ""
    assert one(spark, T.title_weighted, "Hi <p>there") == "Hi Hi Hi Hi there"
    assert one(spark, T.stripped, "a&lt;b&gt;c") == "a b c" and one(spark, T.stripped_entities_first, "a<b&amp;>c") == "a c"


def test_keys_and_features(spark):
    assert one(spark, T.content_key, "  A\tb\n\nC ") == hashlib.sha1(b"a b c").hexdigest()
    assert one(spark, T.word_count, " a b \x1cc ") == 3
    assert one(spark, T.has_year, "in 1999.") and not one(spark, T.has_year, "in 21999")
    assert one(spark, T.has_tag, "a <b> c") and not one(spark, T.has_tag, "a < b")
    assert [one(spark, T.id_shape, x) for x in ("d/12_0123456789abcdef_3.txt", "d/01234567_1.txt", "d/x")] == ["long", "short", "other"]


def test_stemmer(spark):
    # pairs from the published description of the algorithm
    pairs = "caresses caress|ponies poni|ties ti|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|valenci valenc|digitizer digit|operator oper|feudalism feudal|decisiveness decis|hopefulness hope|formaliti formal|sensibiliti sensibl|triplicate triplic|formative form|electriciti electr|goodness good|revival reviv|allowance allow|airliner airlin|adjustable adjust|replacement replac|adoption adopt|communism commun|effective effect|probate probat|rate rate|cease ceas|controll control|roll roll|is is"
    for pair in pairs.split("|"):
        word, want = pair.split()
        assert stem(word) == want, word
    rows = spark.createDataFrame([("d", "running"), ("d", "runs"), ("e", "running")], "domain string, term string")
    assert sorted(r.term for r in with_stems(rows).collect()) == ["run", "run", "run"]
    assert re.fullmatch("[a-z]+", stem("generalizations"))
