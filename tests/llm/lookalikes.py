"""What is put into texts to see whether it is told from personal data: numbers and names behind words that no labeler knows, or that all know."""


def _d(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def _phone(rng):
    a, b, c = rng.choice("23456789") + _d(rng, 2), _d(rng, 3), _d(rng, 4)
    return rng.choice(["call ", "phone ", "tel: ", "mobile ", "fax "]) + "\0" + rng.choice([f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}"])


def _mail(rng):
    name = "".join(rng.choice("abcdefghij") for _ in range(6))
    at, dot = rng.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), (" AT ", " DOT ")])
    return rng.choice(["mail ", "contact ", "write "]) + "\0" + name + _d(rng, 2) + at + name + dot + rng.choice(["com", "org", "de"])


def _date(rng):
    y, m, d = rng.randint(1700, 2090), rng.randint(1, 12), rng.randint(1, 28)
    return rng.choice([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{d}-{m}-{y}", f"{y} {m:02} {d:02}", f"{y}{m:02}{d:02}"])


def _failed_card(rng):
    while True:
        d = "4" + _d(rng, 15)
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
        if total % 10:
            return rng.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4))])


PERSONAL = {"phone": _phone, "mail": _mail}
HARMLESS = {
    "date": _date,
    "date range": lambda rng: f"{_date(rng)} - {_date(rng)}",
    "years": lambda rng: f"{rng.randint(1500, 1950)}-{rng.randint(1951, 2090)}",
    "count": lambda rng: rng.choice(["{} {} {}", "{}.{}.{}", "{} {}"]).format(rng.randint(1, 999), _d(rng, 3), _d(rng, 3)) + ("" if rng.random() < 0.5 else f" {_d(rng, 3)}"),
    "times": lambda rng: f"{rng.randint(0, 23):02}.{rng.randint(0, 59):02} - {rng.randint(0, 23):02}.{rng.randint(0, 59):02}",
    "moment": lambda rng: f"{rng.randint(1900, 2090)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02} {rng.randint(0, 23):02}.{rng.randint(0, 59):02}",
    "coordinates": lambda rng: f"{rng.randint(1, 89)}.{_d(rng, 5)} {rng.randint(1, 179)}.{_d(rng, 5)}",
    "decimal": lambda rng: f"{_d(rng, 2)}.{_d(rng, 7)}",
    "failed card": _failed_card,
    "serial": lambda rng: rng.choice([_d(rng, 8), _d(rng, 11), f"{_d(rng, 5)}-{_d(rng, 5)}", f"{_d(rng, 2)}-{_d(rng, 6)}"]),
}
#: Words that no labeler lists; for what shape or checksum give away, also words that speak for personal data.
PLAIN = ["meeting on ", "between ", "some ", "open ", "about ", "near ", "was ", "nr ", "lot ", "parcel "]
MISLEADING = ["call ", "card ", "phone ", "contact ", "address "]


def planted(rng, text, kind):
    """``text`` with one of a kind between two of its words, and its place if it is personal data."""
    if kind in PERSONAL:
        lead, body = PERSONAL[kind](rng).split("\0")
    else:
        leads = PLAIN if kind == "serial" or rng.random() < 0.5 else MISLEADING
        lead, body = rng.choice(leads), HARMLESS[kind](rng)
    words = text.split(" ")
    at = rng.randrange(len(words) + 1)
    before = " ".join([*words[:at], ""]) + lead if at else lead
    return before + body + " and " + " ".join(words[at:]), (len(before), len(before) + len(body)) if kind in PERSONAL else None
