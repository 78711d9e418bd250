"""Planted personal data and look-alikes: the labelled truth the span classifier learns from.

Every text is a line of filler with one span that is, or only looks like, personal data or a
secret. The lines are made by a seeded generator, so the truth doesn't come from the
classifier's own tests, and a third of it can be kept for measuring.
"""

from __future__ import annotations

import random

HEX, UPPER_HEX = "0123456789abcdef", "0123456789ABCDEF"
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FILLER = "the of and report sent was over under with this page new house river later many before value list table of first second group plan work mit der die und von le la de et que para con".split()


def _luhn(head: str) -> str:
    """head with the check digit that makes it pass."""
    digits = [int(c) for c in reversed(head)]
    total = sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(digits))
    return head + str(-total % 10)


def planted(n: int, seed: int = 20) -> list[tuple[int, str, int, int, bool]]:
    """(number, text, start, end, positive) of n lines; end exclusive, in code points."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    digits = lambda k: some("0123456789", k)
    word = lambda: r.choice(FILLER)
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def secret() -> str:
        kind = r.randrange(7)
        if kind < 3:
            return some(HEX if kind < 2 else UPPER_HEX, r.choice((32, 40, 40, 64)))
        return (some(ALNUM, r.randint(24, 48)), "sk_live_" + some(ALNUM, 24), "ghp_" + some(ALNUM, 36), some(ALNUM + "+/", 43) + "=")[kind - 3]

    def keyed(x: str) -> tuple[str, str]:
        name = r.choice(("token", "api_key", "secret", "password", "access_key", "auth_token", "TOKEN", "API_KEY", "client-secret", "passwd"))
        q = r.choice(('"', "'", ""))
        return f"{name}{r.choice((' = ', '=', ': ', ':'))}{q}", q

    def phone() -> tuple[str, str]:
        lead = r.choice(("call ", "phone: ", "tel. ", "fax ", "mobile ", "Tel: ", "phone "))
        return lead, r.choice((f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)} {digits(7)}", f"{digits(3)} {digits(3)} {digits(4)}", f"0{digits(3)}.{digits(3)}.{digits(3)}"))

    def positive() -> tuple[str, str, str]:
        kind = r.randrange(10)
        if kind < 4:
            x = secret()
            before, after = keyed(x)
            return before, x, after
        if kind == 4:
            return r.choice(("Authorization: Bearer ", "access token: ", "secret key ")), secret(), ""
        if kind == 5:
            return *phone(), ""
        if kind == 6:
            return r.choice(("account ", "account no ", "iban ", "visa ", "card ")), r.choice((digits(10), digits(8), f"{digits(4)} {digits(4)} {digits(4)} {digits(2)}")), ""
        if kind == 7:
            return r.choice(("", "mail ", "write to ")), f"{some(ALNUM[26:], r.randint(3, 9))}.{some(ALNUM[26:52], 4)}@{some(ALNUM[26:52], 7)}.{r.choice(('com', 'org', 'co.uk'))}", ""
        if kind == 8:
            card = _luhn(str(r.choice((4, 5))) + digits(14))
            return "", r.choice((card, " ".join(card[i : i + 4] for i in range(0, 16, 4)))), ""
        return r.choice(("", "call ", "host ")), r.choice((f"+{r.randint(1, 99)} {digits(3)} {digits(7)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", ".".join(str(r.randrange(256)) for _ in range(4)))), ""

    def negative() -> tuple[str, str, str]:
        kind = r.randrange(14)
        if kind == 0:
            return r.choice(("commit ", "revision ", "tree ", "parent ")), some(HEX, 40), ""
        if kind == 1:
            return r.choice(("sha256: ", "md5: ", "checksum ", "digest=", "sha1 = ", "etag: ")), some(HEX, r.choice((32, 40, 64))), ""
        if kind == 2:
            return r.choice(("id ", "uuid: ", "")), "-".join(some(HEX, k) for k in (8, 4, 4, 4, 12)), ""
        if kind == 3:
            return r.choice(("see ", "/", "file ")), r.choice(("/", "-", "_")).join(word() + some(ALNUM[26:52], 4) for _ in range(r.randint(4, 7))), ""
        if kind == 4:
            return "", some("=-_", 1) * r.randint(20, 60), ""
        if kind == 5:
            return "", "".join(word() + some(ALNUM[26:52], 3) for _ in range(r.randint(4, 7))), r.choice(("", "."))
        if kind == 6:
            return r.choice(("on ", "date: ", "")), f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", ""
        if kind == 7:
            return r.choice(("order ", "no. ", "item ", "isbn ", "part number ", "rows ", "page ", "")), r.choice((digits(10), digits(8), f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(1)} {digits(3)} {digits(3)}", digits(14))), ""
        if kind == 8:
            return r.choice(("version ", "release ", "")), f"{digits(1)}.{digits(1)}.{digits(2)}.{r.randint(256, 9999)}", ""
        if kind == 9:
            return r.choice(("+", "rise of ")), f"+{digits(1)} {digits(2)}", ""
        if kind == 10:
            return r.choice(("base64,", "data ", "sequence ")), some("acgt", r.randint(24, 60)) if r.random() < 0.5 else some(ALNUM + "+/", r.randint(60, 90)), ""
        if kind == 11:
            return "", f"{digits(4)} {digits(4)} {digits(4)} {digits(3)}", r.choice(("", "%"))
        # a card's look without its check digit
        card = _luhn(digits(15))
        card = card[:-1] + str((int(card[-1]) + r.randint(1, 9)) % 10)
        return r.choice(("", "", "order ", "no. ", "serial ")), r.choice((card, card, " ".join(card[i : i + 4] for i in range(0, 16, 4)))), ""

    out = []
    for i in range(n):
        good = r.random() < 0.5
        before, x, after = positive() if good else negative()
        head = words(1, 6) + r.choice((" ", "\n", ", ")) + before
        out.append((i, f"{head}{x}{after} {words(1, 5)}{r.choice(('', '.'))}", len(head), len(head) + len(x), good))
    return out
