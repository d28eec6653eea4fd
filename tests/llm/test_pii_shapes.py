"""Pseudonyms of account numbers, addresses, phone numbers and keys against a plain Feistel network."""

import hashlib
import ipaddress
import re

import pytest

from turnscope.llm import pii


def plain_halves(left, right, a, b, kind, secret="k"):
    for i in range(1, pii.ROUNDS + 1):
        draw = int(hashlib.sha256(f"{secret}|{kind}|{i}|{a}|{right}".encode()).hexdigest()[:15], 16)
        left, right, a, b = right, (left + draw) % a, b, a
    return left, right


def plain_digits(digits, kind):
    half = len(digits) // 2
    low, high = plain_halves(int(digits[:half]), int(digits[half:]), 10**half, 10 ** (len(digits) - half), kind)
    return f"{low:0{half}d}{high:0{len(digits) - half}d}"


def plain_mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def plain_iban(iban):
    whole = iban.replace(" ", "")
    digits = iter(plain_digits(re.sub("[^0-9]", "", whole[4:]), "iban"))
    account = re.sub("[0-9]", lambda _: next(digits), whole[4:])
    whole = iter(f"{whole[:2]}{98 - plain_mod97(account + whole[:2] + '00'):02d}{account}")
    return re.sub("[0-9A-Z]", lambda _: next(whole), iban)


def plain_phone(number, code):
    digits = re.sub("[^0-9]", "", number)
    new = iter(digits[:code] + plain_digits(digits[code:], "world-phone"))
    return re.sub("[0-9]", lambda _: next(new), number)


def plain_ipv6(address):
    digits = ipaddress.ip_address(address).exploded.replace(":", "")
    low, high = plain_halves(int(digits[2:17], 16), int(digits[17:], 16), 1 << 60, 1 << 60, "ipv6")
    whole = digits[:2] + f"{low:015x}{high:015x}"
    return ":".join(whole[i : i + 4] for i in range(0, 32, 4))


def replaced(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [(r.text, r.n_replaced) for r in pii.pseudonymised(table, "k").orderBy("doc_id").collect()]


IBANS = [
    "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947",
    "FR1420041010050500013M02606", "MT84MALT011000012345MTLCAST001S", "AT61 1904 3002 3457 3201",
]


def test_ibans(spark):
    found = replaced(spark, [f"to {x}, paid" for x in IBANS])
    assert found == [(f"to {plain_iban(x)}, paid", 1) for x in IBANS]
    assert all(plain_mod97(x[4:] + x[:4]) == 1 for x in (re.sub("[^0-9A-Z]", "", t) for t, _ in found))
    assert found[0][0].replace(" ", "") == found[1][0].replace(" ", "")


def test_iban_beside_a_card(spark):
    text = "AT61 1904 3002 3457 3201 4111 1111 1111 1111"
    (new, count), = replaced(spark, [text])
    assert count == 2 and new.startswith(plain_iban(text[:24])) and "4111 1111" not in new


@pytest.mark.parametrize("address", ["2001:db8::8a2e:370:7334", "2001:0DB8:0:0:0:8A2E:370:7334", "2001:db8:1::1"])
def test_ipv6(spark, address):
    assert replaced(spark, [f"from {address}."]) == [(f"from {plain_ipv6(address)}.", 1)]


def test_phones_of_other_countries(spark):
    numbers = {"+49 30 1234567": 2, "+493012345678": 2, "+44 20 7946 0958": 2, "+7 495 123-45-67": 1, "+353 1 234 5678": 3, "+44 (20) 7946.0958": 2}
    found = replaced(spark, [f"call {x} now" for x in numbers])
    assert found == [(f"call {plain_phone(x, c)} now", 1) for x, c in numbers.items()]


def test_keys(spark):
    keys = ["ghp_" + "aB3" * 12, "sk-proj-" + "x9" * 15, "xoxb-123456789012-abcdef", "AIza" + "q" * 35, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKK", "github_pat_" + "Z" * 30]
    found = replaced(spark, [f"key: {x}\n" for x in keys])
    assert all(n == 1 and x not in t and len(t) == len(x) + 6 for (t, n), x in zip(found, keys))
    assert all(t[5:8] == x[:3] for (t, _), x in zip(found, keys))


def test_what_is_none_of_these(spark):
    texts = [
        "DE88370400440532013000", "std::vector<int>::iterator a::b::c", "at 12:34:56 and ab:cd:ef:01:23:45", "n+4294967295 x[0]+23456789",
        "sk-learn-is-a-long-hyphenated-word", "face::add", "+2345", "GB82 west 1234", "1:2:3:4:5:6:7:8:9",
    ]
    assert replaced(spark, texts) == [(t, 0) for t in texts]


def test_long_text_null_and_repeated_rows(spark):
    long = ("word " * 200_000) + IBANS[0]
    found = replaced(spark, [long, None, "", IBANS[0], IBANS[0]])
    assert found[0] == (long[:-22] + plain_iban(IBANS[0]), 1) and found[1:3] == [(None, 0), ("", 0)] and found[3] == found[4]
