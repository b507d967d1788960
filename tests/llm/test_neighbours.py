"""Pseudonyms of card numbers and IBANs beside other numbers and words, and of dates in either order."""

import datetime

import pytest

from tessera.llm import pseudonyms as P

KEY = b"test"
CARD, AUSTRIAN, SPANISH = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332"


@pytest.mark.parametrize(
    ("text", "value", "kind"),
    [
        (f"{CARD} 123", CARD, "card"), (f"{CARD} 12/25", CARD, "card"), (f"No. 12 {CARD}", CARD, "card"), (f"12 34 {CARD} 5", CARD, "card"), (f"{CARD}-123", CARD, "card"),
        (f"{AUSTRIAN} EUR", AUSTRIAN, "iban"), (f"{SPANISH} SEPA", SPANISH, "iban"), (f"NR12 {AUSTRIAN} TRANSFER", AUSTRIAN, "iban"),
        ("12 2024-02-29 555555", "2024-02-29", "date"), ("on 12/25/2023.", "12/25/2023", "date"), ("on 5/3/2023", "5/3/2023", "date"), ("am 1.12.1999", "1.12.1999", "date"), ("2024-1-5", "2024-1-5", "date"),
    ],
)
def test_beside_others(text, value, kind):
    new, n = P.pseudonymise(text, KEY)
    before, after = text.split(value)
    assert n == {kind: 1} and value not in new and new.startswith(before) and new.endswith(after) and len(new) == len(text)
    assert P.pseudonymise(new, KEY)[1] == {kind: 1}


def test_dates_differ():
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(days=k) for k in range(366)]
    texts = {f"{d.month}/{d.day}/{d.year}" for d in days} | {f"{d.day:02d}/{d.month:02d}/{d.year}" for d in days}
    assert len({P.pseudonymise(x, KEY)[0] for x in texts}) == len(texts)
