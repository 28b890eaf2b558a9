"""The pattern dialect: what it accepts, what it means in Java, and what it tells about matches."""

import re

import pytest
from pyspark.sql import functions as F

from loglathe import EventCount, FieldValue, TimeFormat
from loglathe.functions import patterns
from loglathe.functions.dialect import PatternError, escape, parse
from loglathe.operators import extract

# (pattern, text, what it finds: None for no match, else the whole match and the groups)
FINDS = [
    (r"load=(?<n>\d+)(?P<unit_of>[a-z]+)", "load=41kb", ("load=41kb", "41", "kb")),
    (r"\p{Lu}\p{Ll}+", "der Überfluss", ("Überfluss",)),
    (r"\pL+\PL", "ab1", ("ab1",)),
    (r"\p{Greek}+", "abc λόγος", ("λόγος",)),
    (r"\p{Script=Cyrillic}+", "log журнал", ("журнал",)),
    (r"\p{gc=Nd}+|\p{Uppercase_Letter}", "x٣٤", ("٣٤",)),
    (r"\p{^L}+", "ab12cd", ("12",)),
    (r"[[:digit:]]+[[:^alpha:]]", "a17;", ("17;",)),
    (r"[^[:space:]]+", "  q7 r", ("q7",)),
    (r"[[:upper:][:punct:]]{2}", "aB!c", ("B!",)),
    (r"up(?i)DOWN|side", "upDoWn", ("upDoWn",)),
    (r"(?i)a|b", "B", ("B",)),
    (r"(?:(?i)ab)c", "ABC", None),
    (r"(?i:ab)c", "ABc", ("ABc",)),
    (r"(?i)straße|ÄR", "är", ("är",)),
    (r"(?-u)\w+", "aé", ("a",)),
    (r"\w+", "née2", ("née2",)),
    (r"(?-u:\d+)\d", "1٣", ("1٣",)),
    (r"(?U)x+", "xxx", ("x",)),
    (r"(?U)x+?", "xxx", ("xxx",)),
    (r"(?x) q = (\d +)  # a number", "q=90", ("q=90", "90")),
    (r"(?x)[ a b ]+\ c", "ab c", ("ab c",)),
    (r"end$", "end\n", None),
    (r"(?m)^b$", "a\nb\nc", ("b",)),
    (r"(?m)^$", "a\n", ("",)),
    (r"a.b", "a\nb", None),
    (r"a.b", "a\rb", ("a\rb",)),
    (r"(?s)a.b", "a\nb", ("a\nb",)),
    (r"[a-z&&[^aeiou]]+", "aeixyz", ("xyz",)),
    (r"[\w--\d]+", "12ab3", ("ab",)),
    (r"[a-f~~d-k]+", "deabghf", ("abgh",)),
    (r"[a-z--[c-x]&&[b-y]]+", "aczyb", ("yb",)),
    (r"[]x]+", "ax]x", ("x]x",)),
    (r"[^]x]+", "]ax", ("a",)),
    (r"[a-]+", "b-a", ("-a",)),
    (r"[\]\-\\]+", "a-]\\", ("-]\\",)),
    (r"[\p{L}\d]+", "-é5", ("é5",)),
    (r"[^\W\d]+", "12ab", ("ab",)),
    (r"[^\x{1F600}-\x{1F64F}]", "😀x", ("x",)),
    (r"^.$", "😀", ("😀",)),
    (r"\x41\u0042\U00000043\x{44}", "ABCD", ("ABCD",)),
    (r"\v\t", "\x0b\t", ("\x0b\t",)),
    (r"\b{start}ab\b{end}", "xab ab", ("ab",)),
    (r"\<a\B.", "ba ab", ("ab",)),
    (r"a{2}{3}", "aaaaaaa", ("aaaaaa",)),
    (r"(a++)b", "aab", ("aab", "aa")),
    (r"(ab|a)(c|bcd)?", "abcd", ("abc", "ab", "c")),
    (r"(|x)y", "xy", ("xy", "x")),
    (r"a{0,1}?b", "ab", ("ab",)),
    (r"\.\*\[\]\{\}\(\)\|\#\&\~\-\/", ".*[]{}()|#&~-/", (".*[]{}()|#&~-/",)),
    (r"\Aa\z", "a", ("a",)),
    (r"µs|\bs", "7µs", ("µs",)),
]


def test_patterns_find_what_they_mean(spark):
    for pattern, text, expected in FINDS:
        parsed = parse(pattern)
        outer = f"({parsed.java})"
        row = spark.range(1).select(
            F.regexp_like(F.lit(text), F.lit(parsed.java)).alias("hit"),
            *[F.regexp_extract(F.lit(text), outer, i).alias(f"g{i}") for i in range(1, parsed.groups + 2)],
        ).first()
        got = tuple(row[1:]) if row.hit else None
        assert got == expected, (pattern, parsed.java)
    patterns.check_patterns(spark, [p for p, _, _ in FINDS])


@pytest.mark.parametrize(
    "pattern, problem",
    [
        ("a(b", "unclosed group"), ("a)b", "unopened group"), ("*a", "nothing to repeat"), ("a|+", "nothing to repeat"),
        (r"(a)\1", "back-references"), ("(?=a)", "look-around"), ("(?<!a)b", "look-around"), (r"\Za", "unknown escape"),
        (r"\q", "unknown escape"), ("a\\", "incomplete escape"), ("[a", "unclosed character class"), ("[]", "unclosed"),
        ("[z-a]", "invalid range"), (r"[\d-z]", "invalid range"), ("a{3,2}", "invalid counted"), ("a{", "unclosed counted"),
        ("a{,3}", "invalid counted"), ("(?<n>a)(?<n>b)", "used twice"), ("(?<1>a)", "invalid group name"), ("(?R)a", "flag R"),
        ("(?ii)a", "repeated flag"), ("(?-)a", "missing flag"), ("(?)", "missing flag"), (r"\x{110000}", "hexadecimal"),
        (r"\xg1", "hexadecimal"), (r"\p{", "unclosed property"), (r"\p{Age=6.0}", "property"), (r"[\b]", "unknown escape"),
    ],
)
def test_invalid_patterns_say_why(pattern, problem):
    with pytest.raises(PatternError, match=problem):
        parse(pattern)


def test_the_jvm_has_the_last_word(spark, log):
    with pytest.raises(PatternError, match="JVM refuses.*Klingon"):
        extract.hits(log("x"), [EventCount(r"\p{Klingon}")], TimeFormat())
    with pytest.raises(PatternError, match="unclosed group"):
        extract.hits(log("x"), [EventCount("rate(s")], TimeFormat())


def test_fields():
    assert FieldValue("a.b").regex == r"\ba\.b=([\d\.]+)(\w+)?"
    assert FieldValue("(oops").regex.startswith(r"\b\(oops=")
    assert FieldValue(r"no\Z(\d)").regex.startswith(r"\bno\\Z\(")  # not valid here, so a name
    assert FieldValue(r"x(?:y|z)").regex.startswith(r"\bx\(\?:y")  # valid, but has no group
    assert FieldValue(r"(?<a>\d)(?P<b>\w)").regex == r"(?<a>\d)(?P<b>\w)"
    for three in (r"(\d)(\d)(\w)", r"(?<a>.)((?<b>.))"):
        with pytest.raises(ValueError, match="3 groups"):
            FieldValue(three).regex


@pytest.mark.parametrize("text", ["plain", "a+b (c) [d] {e}", r"back\slash ^$ | . ? * # & - ~", "µ=é 😀\t"])
def test_escaped_text_matches_itself(spark, text):
    parsed = parse(escape(text))
    assert parsed.required == text and parsed.groups == 0
    row = spark.range(1).select(F.regexp_extract(F.lit(f"<{text}>"), f"({parsed.java})", 1)).first()
    assert row[0] == text


def test_required_text():
    cases = {
        r"\bqueue=([\d\.]+)(\w+)?": "queue=", r"(?i)queue=(\d+)": "=", r"a|b": "", r"a(c|d)efg?h": "ef", "a(bc)d": "abcd",
        "x{2}yz": "yz", "(?:lost)+ again": " again", "(?:lost)* again": " again", r"(?x) a b # c": "ab", r"^key\b: ": "key: ",
    }
    assert {p: patterns.required_text(p) for p in cases} == cases


def test_required_text_is_in_every_match(spark):
    """Against all short texts: where the literal is missing, Java finds nothing."""
    alphabet = ["a", "b", "=", "1"]
    texts = [""]
    for _ in range(4):
        texts += [t + c for t in texts for c in alphabet if len(t) < 4]
    texts = sorted(set(texts))
    for pattern in ("a(b|=)1?", "(ab)+=", "a{2}b|b{2}a", "(?i)A=", "a(?:b=)?1", "^(a|b)=", "(a=)?(b1)"):
        parsed = parse(pattern)
        java = re.compile(parsed.java.replace(r"\z", r"\Z").replace("(?iu:", "(?i:"))
        for text in texts:
            hit = java.search(text)
            assert not hit or parsed.required in text
            if hit and parsed.groups and parsed.first_group_tells_match:
                assert hit.group(1)
            if hit and parsed.groups and not parsed.first_group_optional:
                assert hit.group(1) is not None


def test_first_group():
    assert patterns.first_group_optional(r"(?:a(\d)|b)") and patterns.first_group_optional(r"(?:a(\d)){0,3}")
    assert not patterns.first_group_optional(r"(?:a(\d)){1,3}")
    assert patterns.first_group_tells_match(r"x=((?:\d|ab)+)") and not patterns.first_group_tells_match(r"x=(\d*|a)")


def test_patterns_of_events_are_extracted(extracted):
    line = "2025-09-01 07:08:09.010 Queue depth: 17µs"
    assert extracted(FieldValue(r"(?i)DEPTH: (?<n>[[:digit:]]+)(?<u>\pL+)"), line)[0][0] == 0.017
    assert len(extracted(EventCount(r"\p{Lu}\w+ depth"), line)) == 1
