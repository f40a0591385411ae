"""License and secret scans."""

from __future__ import annotations

import random

from lexiloom.llm import licenses, secret_scan

TOKEN = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
MIXED = "gH7xQ2mZ9vK4tR8wB1nY6pL3"


def edits(a: str, text: str) -> int:
    """Fewest edits between a and any part of a text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def harmed(text: str, n: int, rng: random.Random) -> str:
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "~" + text[i:], text[:i] + "~" + text[i + 1 :]])
    return text


def test_a_notice_is_found_exactly_when_some_part_of_the_text_is_near_enough():
    rng = random.Random(3)
    notices = {"mit": "Released under the MIT License", "by": "Licensed under CC BY 4.0"}
    for n in range(120):
        name = rng.choice(list(notices))
        text = "words before " * rng.randrange(3) + harmed(notices[name], rng.randrange(6), rng) + " words after" * rng.randrange(3)
        found = {f[2] for f in licenses.notices_of(text, tuple(notices.items()), 10)}
        near = {k for k, v in notices.items() if edits(v.lower(), text.lower()) <= len(v) // 10}
        assert found == near, (n, text)


def test_license_query_spans_ties_and_odd_rows(spark, docs_of):
    long_ = "lorem ipsum " * 30_000 + "Licensed under the Apache License, Version 2.0." + " dolor" * 30_000
    rows = [(1, "X. released  under the MIT Licence."), (2, None), (3, ""), (4, long_), (None, "Licensed under CC BY-NC 4.0"), (1, "X. released  under the MIT Licence."), (5, "Éé Licensed under CC BY-NC 4.0 licensed under cc by-nc 4.0")]
    got = sorted((r.doc_id or 0, r.license, r.start, r.end, r.errors) for r in licenses.scan(docs_of(rows, extra=True)).collect())
    assert got == [(0, "CC-BY-NC", 0, 27, 0), (1, "MIT", 3, 34, 2), (1, "MIT", 3, 34, 2), (4, "Apache-2.0", 360_000, 360_046, 0), (5, "CC-BY-NC", 3, 30, 0), (5, "CC-BY-NC", 31, 58, 0)]
    assert licenses.scan(docs_of([])).count() == 0


def test_secrets_stand_out_and_digests_and_identifiers_do_not(spark, docs_of):
    clean = [
        f"commit: {TOKEN}",
        TOKEN,
        "sha256: e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
        "token = e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
        "id 123e4567-e89b-12d3-a456-426614174000 end",
        "12345678901234567890123456789",
        "getElementByIdentifierNameOrDefaultValue",
        "a-long-path/of_plain/words-and-more",
        "thndreathththereonandmoreoftheseletters",
        "====================================",
    ]
    dirty = [f'x token = "{TOKEN}" y', f"key: {MIXED}", f"see {MIXED}."]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(dirty)]
    got = secret_scan.scan(docs_of(rows)).collect()
    assert sorted(r.doc_id for r in got) == [100, 101, 102], got
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.end] == r.secret and r.chars_per_token <= 2.2 for r in got)


def test_scan_and_redact_odd_rows(spark, docs_of):
    long_ = "plain words " * 50_000 + f' token = "{TOKEN}" ' + "more words " * 50_000
    rows = [(1, None), (2, ""), (3, long_), (None, f"key {MIXED}"), (4, f"é {MIXED} {MIXED}"), (4, f"é {MIXED} {MIXED}")]
    docs = docs_of(rows, extra=True)
    assert sorted((r.doc_id or 0, r.start) for r in secret_scan.scan(docs).collect()) == [(0, 4), (3, 600_010), (4, 2), (4, 2), (4, 27), (4, 27)]
    new = secret_scan.redact(docs)
    assert new.columns == docs.columns
    out = {(r.doc_id, r.text, r.n_chars) for r in new.collect()}
    assert (1, None, None) in out and (2, "", 0) in out and (None, "key [SECRET]", 12) in out and (4, "é [SECRET] [SECRET]", 19) in out
    assert new.count() == 6 and all(TOKEN not in (t or "") for _, t, _ in out)
    assert secret_scan.redact(docs_of([])).count() == 0


def test_letters_of_one_case_and_short_named_strings():
    tokens = secret_scan.encoding(secret_scan.VOCABULARY)
    found = lambda t: [x[2] for x in secret_scan.secrets_of(t, tokens, 2.2)]
    key = "qwhzkxvbnplmtrsdfgjcyowe"
    assert found(f'token = "{key}"') == [key] and found(f"see {key}.") == [key] and found(key.upper()) == [key.upper()]
    assert found(f'password: "{key[:16]}"') == [key[:16]] and found(f"see {key[:16]}.") == []
    assert found("incomprehensibilities counterrevolutionaries") == [] and found("key: internationalization") == []


def judged(text: str, tokens) -> set[tuple[int, int]]:
    """Brute force: every maximal run, and every run between separators, judged by its definition."""
    import re

    alphabet = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    found, i = set(), 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in alphabet:
            j += 1
        if j - i >= secret_scan.LEAST_NAMED:
            a, b = i, j
            while a < b and text[a] == "=":
                a += 1
            while a < b and text[a] in "-_/":
                a += 1
            while b > a and text[b - 1] in "-_/":
                b -= 1

            def random_(x: int, y: int, before: str) -> bool:
                s = text[x:y]
                named = secret_scan._NAMED.search(before) is not None
                least = secret_scan.LEAST_NAMED if named else secret_scan.LEAST
                return len(s) >= least and not secret_scan.excluded(s, before) and len(s) / len(tokens.encode_ordinary(s)) <= 2.2

            before = text[max(0, i - 40) : i]
            if random_(a, b, before):
                found.add((a, b))
            elif not secret_scan.digest(text[a:b], before):
                at = a
                for part in re.split("([/=_-])", text[a:b]):
                    if len(part) < b - a and random_(at, at + len(part), text[max(0, at - 40) : at]):
                        found.add((at, at + len(part)))
                    at += len(part)
        i = max(j, i + 1)
    return found


def test_scan_query_equals_brute_force(spark, docs_of):
    rng = random.Random(8)
    tokens = secret_scan.encoding(secret_scan.VOCABULARY)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secret = lambda: "".join(rng.choice(chars) for _ in range(rng.randrange(12, 44)))
    parts = [secret, lambda: "home/user/projects/production/config/" + secret(), lambda: 'token = "' + secret() + '"', lambda: "%040x" % rng.getrandbits(160), lambda: "commit: %040x" % rng.getrandbits(160), lambda: "api_key=" + secret(), lambda: "plain words of text", lambda: "getElementByIdentifierName", lambda: "=" * 25, lambda: "-_-" + secret() + "/--"]
    rows = [(i, " ".join(rng.choice(parts)() for _ in range(6))) for i in range(200)]
    got = {(r.doc_id, r.start, r.end) for r in secret_scan.scan(docs_of(rows)).collect()}
    assert got == {(d, a, b) for d, t in rows for a, b in judged(t, tokens)} and len(got) > 200


def test_a_path_of_words_does_not_hide_a_secret():
    tokens = secret_scan.encoding(secret_scan.VOCABULARY)
    found = lambda t: [x[2] for x in secret_scan.secrets_of(t, tokens, 2.2)]
    path = "api/v1/organizations/engineering/projects/production/webhooks/"
    rng = random.Random(4)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = ["".join(rng.choice(chars) for _ in range(20)) for _ in range(60)]
    caught = [x for x in some if found(f"see {x}.")]
    assert len(caught) >= 55 and all(any(x in f for f in found(path + x)) for x in caught)
    assert any(found(path + x) == [x] for x in caught)
    assert found("sha256: " + "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855") == [] and found(path) == []


def test_many_notices_in_one_text():
    text = " and ".join(["Licensed under CC BY 4.0", "All rights reserved"] * 4_000)
    found = licenses.notices_of(text, tuple(licenses.NOTICES.items()), 10)
    assert len(found) == 8_000 and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
