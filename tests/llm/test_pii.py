"""Base patterns against plain regular expressions, the graph against a model in plain Python, and planted identifiers."""

import hashlib
import random
import re

import pytest
from alertlake.llm import pii, queries
from helpers import DOCS, awkward_docs, docs_frame, empty

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn_by_hand(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def base_by_hand(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(part) <= 255 for part in m.group().split("."))]
    spans += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn_by_hand(digits(m))]
    return spans + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def written(spans):
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1])))


def card(rng):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + d for d in "0123456789" if luhn_by_hand(body + d))


def test_base_spans_equal_the_plain_expressions():
    rng = random.Random(1)
    alphabet = "ab1 9.@+-()%é"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(20_000)]
    texts += [f"x {card(rng)} y {card(rng)[:4]}-{card(rng)}", "a@b@c.d@e.f", "256.1.1.1 0001.2.3.4 1.2.3.4.5.6.7.8", "+1 (377) 555-0271 +49 30 1234567 2024 99999999"]
    for text in texts:
        assert pii.base_spans(text) == base_by_hand(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "+1" * 200_000, "a@" * 200_000, "1." * 200_000, "a.b" * 100_000 + "@", "1 " * 200_000):
        pii.slots(text, pii.base_spans(text))


def corpus(seed=3):
    """Ordinary text, seeds in a telling context, and identifiers in it that no base pattern knows."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru") for b in ("ten", "sal", "dor", "vin", "pek")]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, hidden = [], {}
    for i in range(400):
        text = fill(rng.randrange(5, 60))
        if i % 4 == 0:
            text += f" reach me at: +49 {rng.randrange(10**8, 10**9)} thanks {fill(5)}"
        if i % 10 == 3:
            head = f"{text} reach me at: "
            number = f"0{rng.randrange(100, 999)} {rng.randrange(10**6, 10**7)}"
            hidden[i] = ("phone", len(head), len(head) + len(number))
            text = f"{head}{number} thanks {fill(4)}"
        if i % 10 == 5:
            text += f" order {rng.randrange(10**7, 10**8)} of {fill(3)}"
        docs.append((i, text))
    # Found by its context once, told by itself later; and the same in a chain of two contexts.
    told = docs[3][1][hidden[3][1] : hidden[3][2]]
    docs += [(1000, f"{fill(4)} {told} {fill(4)}"), (1001, f"{fill(3)} year 2024 {fill(3)}")]
    start = docs[-2][1].index(told)
    hidden[1000] = ("phone", start, start + len(told))
    return docs, hidden


def model(docs):
    """The bootstrap in plain Python, over the same slots and keys."""
    fills, edges, seeds, noted = {}, {}, {}, {}
    for row, text in docs:
        text = text or ""
        base, marks = pii.mentions_of(text)
        noted[row] = (base, marks)
        for key in pii.context_keys(text, pii.slots(text, base))[0].ravel().tolist():
            fills[key] = fills.get(key, 0) + 1
        for kind, _, _, instance, _, patterns in marks:
            if kind:
                seeds[instance] = min(seeds.get(instance, kind), kind, key=pii.KINDS.index)
            for p in patterns:
                edges.setdefault(p, {}).setdefault(instance, 0)
                edges[p][instance] += 1
    known = {i: (kind, 1.0) for i, kind in seeds.items()}
    while True:
        good = {}
        for p, held in edges.items():
            for kind in pii.KINDS:
                mine = [i for i in held if known.get(i, ("",))[0] == kind]
                purity = sum(held[i] * known[i][1] for i in mine) / (fills[p] + 1)
                if len(mine) >= pii.LEAST_INSTANCES and purity >= pii.LEAST_PURITY:
                    good[p, kind] = purity
        doubt = {}
        for (p, kind), purity in good.items():
            for i in edges[p]:
                if i not in known:
                    doubt[i, kind] = doubt.get((i, kind), 1.0) * (1 - purity)
        fresh = {}
        for (i, kind), d in doubt.items():
            if i not in fresh or (1 - d) > fresh[i][1]:
                fresh[i] = (kind, 1 - d)
        if not fresh:
            break
        known |= fresh
    out = {}
    for row, (base, marks) in noted.items():
        found = set()
        for kind, start, end, instance, size, patterns in marks:
            if kind is None and (any((p, k) in good for p in patterns for k in pii.KINDS) or (size >= pii.LONG_ENOUGH and instance in known and instance not in seeds)):
                found.add((start, end))
        out[row] = (base, found)
    return out


def test_rounds_equal_the_model_and_find_what_is_hidden(spark):
    docs, hidden = corpus()
    want = model(docs)
    got = {row.doc_id: row for row in pii.find(docs_frame(spark, [(i, text, "en", "s", 1) for i, text in docs])).collect()}
    for i, (base, found) in want.items():
        assert [tuple(s) for s in got[i].base] == base and {(s.start, s.end) for s in got[i].found} == found
    assert {i: tuple(got[i].found[0]) for i in got if got[i].found} == hidden


def test_query_takes_awkward_rows(spark, tmp_path):
    docs, hidden = corpus()
    mail = "write to a.b@c.de or call +49 30 1234567, from 10.0.0.1"
    rows = [(i, text, "en", "s", 1) for i, text in docs] + [(i and i + 5000, text, *rest) for i, text, *rest in awkward_docs()] + [(None, mail, None, None, None), (9000, mail, "en", "s", 1), (9000, mail, "en", "s", 1), (9000, "x" * 300_000 + " " + mail, "en", "s", 1)]
    docs_frame(spark, rows).selectExpr("*", "'x' AS slots", "1 AS row", "2 AS base").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_contextual_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), hashlib.sha256(written(base_by_hand(text or "")).encode()).hexdigest(), written(base_by_hand(text or "") + [hidden[k] for k in [i] if k in hidden])) for i, text, *_ in rows)
    assert sorted((str(row.doc_id), row.base_sha256, row.spans) for row in got) == want
    assert all(sum(kind + ":" in s for s in row.spans.split(",")) == row[f"n_{kind}"] for row in got if row.doc_id not in hidden for kind in pii.KINDS)


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "s", 1)]])
def test_tables_without_text(spark, tmp_path, rows):
    (docs_frame(spark, rows) if rows else empty(spark, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_contextual_pii(spark, str(tmp_path)).collect()
    assert [(row.n_email, row.base_sha256, row.spans) for row in got] == [(0, hashlib.sha256(b"").hexdigest(), "")] * len(rows)
