"""URL verdicts and pseudonyms, case by case and against brute force."""

import random
import re

import pytest
from measureframe.llm.feistel import KINDS, Permutation, Pseudonyms, luhn_digit, pseudonymise
from measureframe.llm.url_filter import Rules, RULES, Vocabulary, host_and_path, judge_urls


@pytest.mark.parametrize("url, want", [
    (None, ("", "")), ("", ("", "")), ("no scheme/x", ("", "")), ("http://Ä.Example.COM/Path?q#f", ("Ä.example.com", "/Path")),
    ("http://a?b/c", ("a", "")), ("http://a#/c", ("a", "")), ("x://h/p://q?r", ("h", "/p://q")), ("http:///p", ("", "/p")), ("a://b", ("b", "")),
])
def test_host_and_path(url, want):
    assert host_and_path(url) == want


@pytest.mark.parametrize("url, rule, verdict", [
    ("http://x.org/", "org/", "allow"), ("http://org/a", "org/", "allow"), ("http://xorg/a", None, "allow"), ("http://x.org", None, "allow"),
    ("http://a.example.org/es/1", "example.org/es/", "block"), ("http://example.org/en/10", "example.org/en/1", "block"),
    ("http://example.org/en/2", "org/", "allow"), ("http://myexample.org/es/", "org/", "allow"), ("http://casino.com/fr/x", "com/fr/", "allow"),
    ("http://casino.com/x", None, "block"), ("http://casinos.com/x", None, "allow"), ("http://cheap-pills.com/", None, "block"),
    ("http://cheap-cheap.com/cheap", None, "allow"), ("http://FREE.com/WIN", None, "block"), ("cheap pills", None, "block"), (None, None, "allow"), ("", None, "allow"),
])
def test_verdicts(spark, url, rule, verdict):
    r = judge_urls(spark.createDataFrame([(1, url, "x", "y")], "page_id bigint, url string, host string, verdict string")).first()
    assert (r.rule, r.verdict, r.row.host) == (rule, verdict, "x")


def test_longest_rule_by_brute_force():
    rng = random.Random(4)
    rules = Rules.of(RULES)
    for _ in range(3000):
        host = ".".join(rng.choices(["a", "example", "org", "com"], k=rng.randint(0, 4)))
        path = rng.choice(["", "/", "/es/", "/en/1", "/en/", "/fr/x", "/de/", "/en/19"])
        fits = [(r, v) for v, r in RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert rules.find(host, path) == max(fits, key=lambda x: len(x[0]), default=None)


def test_vocabulary_by_brute_force():
    rng = random.Random(5)
    strict, soft = ["bad", "badger", "a-b"], ["ad", "free", "free-ad"]
    found = Vocabulary(strict, soft)
    for _ in range(3000):
        url = "".join(rng.choices(["bad", "ad", "free", "ger", "-", "a-b", "/", "x", "B", "A"], k=6))
        count = lambda terms: sum(bool(re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", url.lower())) for t in terms)
        assert found.counts(url) == (count(strict), count(soft))


def test_url_filter_of_nothing_and_repeats(spark):
    df = spark.createDataFrame([(1, "http://x.com/poker"), (1, "http://x.com/poker"), (None, None)], "page_id bigint, url string")
    assert sorted((r.row.page_id or 0, r.verdict) for r in judge_urls(df).collect()) == [(0, "allow"), (1, "block"), (1, "block")]
    assert judge_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_one(size):
    p = Permutation(b"key", "t", size)
    out = [p.apply(i) for i in range(size)]
    assert sorted(out) == list(range(size)) and [p.apply(x, back=True) for x in out] == list(range(size))
    if size > 90:
        assert out != list(range(size)) and out != [Permutation(b"other", "t", size).apply(i) for i in range(size)]


TEXT = ("mail dikcoc.46@mail4.example.com, +1 (988) 555-2485 4785380592391139 4111111111111111 152.143.123.131 2020-02-29 29.02.2020 02/29/2020 "
        "123-45-6789 GB82 WEST 1234 5698 7654 32 and +49 30 12345678 (988) 555-2485 4785-3805-9239-1139 a@b.co")
KEPT = "v1.2.3.4.5 999.1.1.1 4111111111111112 2020-02-30 000-12-3456 1234567 x4111111111111111 GB82 WEST 1234 5698 7654 33 @ a@b 0x12"


def test_pseudonyms_keep_the_format_link_and_can_be_undone():
    own = Pseudonyms(b"key")
    new, found = own.replace(TEXT)
    assert dict(found) == {"email": 2, "phone": 3, "card": 3, "ip": 1, "date": 3, "ssn": 1, "iban": 1}
    assert own.replace(new, back=True)[0] == TEXT
    assert not set(re.findall(r"\S*\d{3,}\S*", TEXT)) & set(re.findall(r"\S*\d{3,}\S*", new)) - {"(988)"}
    assert len(new) == len(TEXT) + len(re.search(r"\d+\.\d+\.\d+\.\d+", new).group()) - len("152.143.123.131")
    cards = re.findall(r"\b\d{16}\b", new)
    assert all(luhn_digit(c[:-1]) == c[-1] for c in cards)
    assert new.split()[-2].replace("-", "") == cards[0]  # one number, two formats
    iso, german, us = re.search(r"(\d{4}-\d\d-\d\d) (\S+) (\S+)", new).groups()
    y, m, d = iso.split("-")
    assert german == f"{d}.{m}.{y}" and us == f"{m}/{d}/{y}"
    assert Pseudonyms(b"key").replace(TEXT)[0] == new and Pseudonyms(b"other").replace(TEXT)[0] != new


def test_what_is_not_valid_stays():
    assert Pseudonyms(b"key").replace(KEPT) == (KEPT, {})
    assert Pseudonyms(b"key").replace(None) == (None, {}) and Pseudonyms(b"key").replace("") == ("", {})


def test_every_value_of_a_kind_comes_back():
    rng, own = random.Random(6), Pseudonyms(b"key")
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    for _ in range(300):
        payload = rng.choice("3456") + digits(rng.choice([12, 14]))
        values = [payload + luhn_digit(payload), f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}", ".".join(str(rng.randint(0, 255)) for _ in range(4)),
                  f"{rng.randint(1000, 9999):04d}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.choice('abc')}{digits(3)}.Xy@m.example.org"]
        text = " ".join(values)
        new, found = own.replace(text)
        assert found.total() == 5 and own.replace(new, back=True)[0] == text


def test_pseudonymise(spark):
    rows = [(1, TEXT, "q"), (1, TEXT, "q"), (2, None, None), (None, "", None), (3, "plain " * 50_000 + "4785380592391139", "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, new_text string")
    got = pseudonymise(df, b"key").collect()
    own = Pseudonyms(b"key")
    assert sorted(((r.row.doc_id, r.new_text, r.row.new_text) for r in got), key=repr) == sorted(((i, own.replace(t)[0], q) for i, t, q in rows), key=repr)
    assert all(getattr(r, f"n_{k}") == own.replace(r.row.text)[1][k] for r in got for k in KINDS)
    back = pseudonymise(pseudonymise(df, b"key").selectExpr("row.doc_id", "new_text AS text"), b"key", back=True)
    assert sorted(((r.row.doc_id, r.new_text) for r in back.collect()), key=repr) == sorted(((i, t) for i, t, _ in rows), key=repr)
    assert pseudonymise(df.limit(0), b"key").count() == 0


#: Valid data of each kind; IBANs of lengths that are multiples of four and others.
VALUES = {
    "iban": ["AT611904300234573201", "AT61 1904 3002 3457 3201", "BE68539007547034", "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "SE45 5000 0000 0583 9825 7466",
             "PL61 1090 1014 0000 0712 1981 2874", "CZ65 0800 0000 1920 0014 5399", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"],
    "phone": ["+49 30 1234567", "+49 30 123456", "+49 170 123 45 67", "+49 30 1234 5678", "+49 (0) 30 12345678", "+33 6 12 34 56 78", "+44 20 7946 0958", "+358 40 123 4567", "+7 495 123-45-67",
              "+1 (988) 555-2485", "988-555-2485"],
    "card": ["4785380592391139", "4785-3805-9239-1139", "4785 3805 9239 1139"], "ssn": ["123-45-6789"], "ip": ["152.143.123.131"],
    "date": ["2020-02-29", "29.02.2020", "02/29/2020"], "email": ["dikcoc.46@mail4.example.com"],
}
AFTER = ["BIC OPSKATWW", "EUR 500", "USD", "A1B2 C3", "15 Uhr", "15:30", "2021", "7", "1234 X", "2021-05-06", "05.06.2021", "05/06/2021", "152.143.123.131", "123-45-6789", "988-555-2485", "4785 3805 9239 1139",
         "+49 30 12345678", "AT61 1904 3002 3457 3201", "word"]


@pytest.mark.parametrize("kind", KINDS)
def test_what_follows_changes_nothing(kind):
    """The value gets the pseudonym that it has alone, and so does what follows."""
    own = Pseudonyms(b"key")
    for value in VALUES[kind]:
        alone, found = own.replace(value)
        assert found == {kind: 1} and alone != value
        for after in AFTER:
            text, rest = f"to {value} {after} and", own.replace(after)
            new, both = own.replace(text)
            assert new == f"to {alone} {rest[0]} and", text
            assert both == found + rest[1] and own.replace(new, back=True)[0] == text


def test_phone_keeps_its_whole_country_code_and_its_extension():
    own = Pseudonyms(b"key")
    assert own.replace("+358 40 123 4567")[0].startswith("+358 ")
    for text in ("+49 30 1234567-15", "+49.30.1234.5678", "+49 30 12 34 56 78", "+86 138 1234 5678", "+91 98765 43210", "+852 1234 5678"):
        new, found = own.replace(text)
        assert found == {"phone": 1} and not set(re.findall(r"\d{4,}", text)) & set(re.findall(r"\d{4,}", new))
        assert own.replace(new, back=True)[0] == text
    rng = random.Random(7)
    for _ in range(2000):
        text = f"+{rng.choice([49, 33, 7, 358, 852, 299, 62])}" + "".join(rng.choice(" .-") * rng.randint(0, 1) + str(rng.randint(0, 9)) for _ in range(rng.randint(6, 13))) + rng.choice(["", " 15", " 2021-05-06", " 1.2.3.4"])
        assert own.replace(own.replace(text)[0], back=True)[0] == text


def test_a_date_with_a_time_behind_it_is_replaced_and_comes_back():
    own = Pseudonyms(b"key")
    plain = own.replace("on 2021-05-06 at", False)[0].split()[1]
    for text in ("2021-05-06T10:00:00", "2021-05-06T10:00:00Z,", "(2021-05-06T23:59+02:00)"):
        new, counts = own.replace(text, False)
        assert counts["date"] == 1 and new == text.replace("2021-05-06", plain) and own.replace(new, True)[0] == text
    assert own.replace("2021-05-06Tx 2021-05-06T1", False)[1]["date"] == 0
