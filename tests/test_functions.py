import html
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafwright.functions import replies, text


def test_sentences(one):
    cases = {
        "One two. Three four! Five?": ["One two.", "Three four!", "Five?"],
        "Mr. Smith met Dr. Who. They ate etc. and left.": ["Mr. Smith met Dr. Who.", "They ate etc. and left."],
        "a. B. Long enough.": ["Long enough."],
        "今日は。明日も！": ["今日は。", "明日も！"],
        'He said. "Go on." (So be it.)': ["He said.", '"Go on." (So be it.)'],
        "no split. here": ["no split. here"],
        "ab": ["ab"],
        "": [""],
        "Casino. Then x": ["Casino.", "Then x"],
    }
    assert one(text.sentences, list(cases)) == list(cases.values())


def test_sentences_never_lose_order(one):
    import random

    rnd = random.Random(3)
    words = ["Mr.", "end.", "Why?", "the", "No.", "Go!", "。", "A", "longer", '"Quote', "i.e.", "\n", " "]
    given_texts = [" ".join(rnd.choice(words) for _ in range(30)) for _ in range(200)]
    for source, parts in zip(given_texts, one(text.sentences, given_texts)):
        at = 0
        for p in parts:
            at = source.index(p, at) + len(p)


def test_headings(one):
    yes = ["CHAPTER I", "Chapter 12", "Ch. 5", "Chap. V", "第三章", "제 2 장", "【 一 】", "THE LONG ROAD HOME", "AUTHOR'S PREFACE."]
    no = ["Chapter 1. Title", "The Long Road", "ABC", "CHAPTER", "A VERY LONG TITLE IN SEVEN CAPITAL WORDS", "", "chapter 1"]
    assert one(text.is_heading, yes) == [True] * len(yes)
    assert one(text.is_heading, no) == [False] * len(no)


def test_boilerplate(one):
    # An end marker begins with its last two stars, so a third one before them stays.
    whole = "Head\n*** START OF THE BOOK ***\nProduced by X at PGDP.net\nLine\n\nBody *** text\n** END OF\nTHE BOOK *** tail"
    assert one(text.without_boilerplate, [whole, "no markers", "*** END OF IT ***", ""]) == ["Line\n\nBody *** text\n", "no markers", "*", ""]
    twice = "Produced by A, distributed proofreading\nx\nProduced by B, distributed proofreading\ny"
    assert one(text.without_boilerplate, [twice]) == ["x\nProduced by B, distributed proofreading\ny"]


def test_strip_and_blank(one):
    assert one(text.strip, ["\n a ", "　x y\t", ""]) == ["a", "x y", ""]
    assert one(text.is_blank, [None, "", "  \n", "x"]) == [True, True, True, False]


def test_xml_escape(one):
    cases = ["a & b", "&amp;amp;lt;", 'x < "y" >', "&copy; &eacute;", None, "&nosuch; &#65;", ""]

    def model(s):
        s, before = s or "", None
        while before != s:
            before, s = s, html.unescape(s)
        return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    assert one(text.xml_escape, cases) == [model(c) for c in cases]


def test_names(one):
    assert one(text.safe_filename, ["a/b:c é_1-", "", "x" * 100]) == ["a_b_c é_1-", "book", "x" * 80]
    assert one(text.language_base, ["en-US", None, "", "ZH"]) == ["en", "en", "en", "zh"]
    assert one(text.language_name, ["fr", "xx"]) == ["French", "xx"]


def test_percent(one):
    done = [(9, 400), (1, 3), (5, 0), (400, 400)]
    assert one(lambda a, b: text.percent(a, b), done, "long;long") == [round(100 * a / b, 1) if b else 0 for a, b in done]


def test_slots(one):
    cases = [
        ("[1] a\n[2] b", 2, ["a", "b"]), ("[1]\na\nmore\n[2] b", 2, ["a\nmore", "b"]), ("[2] b\n[1] a", 2, ["a", "b"]), ("[1] a\n[1] z\n[2] b", 2, ["a", "b"]),
        ("[1] a\n[9] x\n[2] b", 3, ["a", "b", ""]), ("[1] blob", 5, [""] * 5), ("[1] blob", 3, ["blob", "", ""]), ("a⟦P⟧b", 2, ["a", "b"]), ("a⟦P⟧b⟦P⟧c", 2, ["a", "b"]),
        ("blob", 1, ["blob"]), ("blob", 2, ["", ""]), ("", 1, [""]), ("[1] a\rb\n[2] c", 2, ["a\rb", "c"]), ("[99999999999] a\n[1] b", 1, ["b"]), ("x", 0, []),
    ]
    assert one(replies.slots, [c[:2] for c in cases], "string;int") == [c[2] for c in cases]


def test_slots_count(one):
    import random

    rnd = random.Random(5)
    pieces = ["[1] ", "[2]", "[3] x", "\n", "word", "⟦P⟧", " ", "[0]", "\n\n"]
    cases = [("".join(rnd.choice(pieces) for _ in range(12)), rnd.randrange(1, 6)) for _ in range(300)]
    assert [len(s) for s in one(replies.slots, cases, "string;int")] == [n for _, n in cases]


def test_tags(one):
    cases = ["<i>a</i> <b>b</b>", "none", "<a href='x'>y</A><br>", "<i></i>" * 12, ""]
    assert one(replies.stash_tags, cases[:3]) == ["◀TAG0▶a◀TAG1▶ ◀TAG2▶b◀TAG3▶", "none", "◀TAG0▶y◀TAG1▶<br>"]
    assert one(lambda c: replies.restore_tags(replies.stash_tags(c), replies.inline_tags(c)), cases) == cases


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="<>/iba &;é\n", max_size=30), min_size=20, max_size=40))
def test_stash_is_undone(one, texts):
    assert one(lambda c: replies.restore_tags(replies.stash_tags(c), replies.inline_tags(c)), texts) == texts


def test_lenient_json(one):
    cases = ['{"a": "b"}', '```json\n{"a": "b"}\n```', 'Sure: {"a": "b"} ok', '["a"]', '{"a": ', "none", "", '{"a": 1}']
    found = one(replies.lenient_json, cases)
    assert [f and f.get("a") for f in found] == ["b", "b", "b", None, None, None, None, "1"]


def test_prompts(one, spark):
    terms = spark.createDataFrame([([("Emma", "엠마"), ("Box", "<CONSISTENT:Box>")],)], "t array<struct<term:string,rendering:string>>")
    said = terms.select(replies.translation_prompt(F.lit("fr"), F.col("t"))).first()[0]
    assert "French" in said and "- Emma: 엠마\n- Box: choose one rendering" in said
    own = terms.select(replies.translation_prompt(F.lit("fr"), F.col("t"), "From {language}.")).first()[0]
    assert own.startswith("From French.\n")
    assert one(lambda c: replies.numbered(F.array(c, c)), ["x"]) == ["[1]\nx\n\n[2]\nx"]
    assert one(lambda c: replies.grounding_query(c, F.lit("T")), ["Emma"]) == ["Emma T 한국어 번역"]
    assert one(lambda c: replies.single_reply(c, F.array(F.lit("<i>"))), [" [3] ◀TAG0▶x⟦P⟧ "]) == ["<i>x"]


def test_image_types(one):
    data = [b"\xff\xd8\xff\x00", b"\x89PNG\r\n\x1a\n", b"GIF89a", b"RIFF\0\0\0\0WEBP", b"", b"RIFF"]
    assert [x["extension"] for x in one(text.image_type, data, "binary")] == [".jpg", ".png", ".gif", ".webp", ".jpg", ".jpg"]
    assert re.match("image/", one(text.image_type, data[:1], "binary")[0]["media_type"])


def test_entities_are_those_of_the_standard_library(spark):
    import html
    import random

    from leafwright.functions import entities

    rnd = random.Random(1)
    names = list(html.entities.html5)
    bits = ["&", "#", "x", ";", "amp", "lt", "&amp;", "&#38;", "é", "😀", " ", "notin", "&#x26;", "0", "9", "f", "&#"]
    texts = ["&" + n for n in names] + [f"&#{k}" for k in (*range(300), 0xD800, 0xDFFF, 0xFDD0, 0xFDEF, 0xFFFE, 0xFFFF, 0x10FFFF, 0x110000, 10**25, 0x1FFFE, 128512)] + [f"&#x{k:x};" for k in (*range(300), 0xD800, 0x1F600, 1 << 90)]
    texts += ["".join(rnd.choice(bits + names[:200]) for _ in range(rnd.randrange(1, 9))) for _ in range(2000)] + ["&" + "amp;" * 40, "&" + "amp" * 30, "&#000000000065;", "a&b", "&ampx;", "&notit;", "&" + "z" * 40 + ";", "", "&&&;"]

    def settled(x):
        while (y := html.unescape(x)) != x:
            x = y
        return x

    frame = spark.createDataFrame(list(enumerate(texts)), "k long, s string").repartition(4)
    rows = frame.select("k", entities.unescaped_once(F.col("s")).alias("once"), entities.unescaped(F.col("s")).alias("all"))
    assert {r["k"]: (r["once"], r["all"]) for r in rows.collect()} == {k: (html.unescape(s), settled(s)) for k, s in enumerate(texts)}
    assert "Python" not in frame.select(text.xml_escape(F.col("s")))._jdf.queryExecution().executedPlan().toString()


def test_code_points_by_bitmaps(spark):
    from leafwright.operators import coverage

    texts = ["a\0b", "😀é", None, "", "￿\U0010ffff", "耀老翿"] + [chr(k) for k in range(0x7FF0, 0x8010)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    assert sorted(r["cp"] for r in coverage.code_points(frame, always=False).collect()) == sorted({ord(c) for t in texts if t for c in t})
    assert coverage.code_points(frame.limit(0)).count() == 0x7F - 0x20 + 1
