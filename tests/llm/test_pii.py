import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from hubloom.llm import pii


def brute_base(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        total = sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(digits[::-1]))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            found.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


PIECES = ["a.b@c.de", "@", "x@y", "user+tag@mail-1.example.org", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111",
          "4111111111111111", "+1 (988) 555-2485", "+49", "-", " ", " ", "é", "(5)", "12", "3.4", "%a@b.c@d.e", "٣٤", ".", "+"]


def texts(n=400):
    rng = random.Random(8)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_base_matches_brute_force():
    for text in texts():
        got = sorted(pii.base_spans(text), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert got == brute_base(text), text


def corpus():
    rng = random.Random(9)

    def card():
        digits = [rng.randrange(10) for _ in range(15)]
        return next("".join(map(str, digits)) + str(d) for d in range(10) if pii.luhn("".join(map(str, digits)) + str(d)))

    rows = []
    for i in range(400):
        rows.append(rng.choice([
            lambda: f"write to u{i}@mail{i % 9}.example.com today", lambda: f"call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} now",
            lambda: f"pay with {card()} please", lambda: f"host {'.'.join(str(rng.randint(1, 255)) for _ in range(4))} is up",
            lambda: f"version 2.0 of {rng.randint(1900, 2030)} and 3.1", lambda: f"number {rng.randint(10**15, 10**16 - 1) // 10 * 10 + 1} is one",
            lambda: "no data here"])())
    return rows


@pytest.fixture(scope="module")
def weights():
    return pii.fit([e for text in corpus() for e in pii.examples_of(text)])


def test_base_spans_stay_and_more_come(weights):
    for text in texts(150) + corpus():
        base, every = pii.find_spans(text, weights)
        assert set(base) <= set(every)
    base, every = pii.find_spans("cards 4111111111111111 4111111111111111 here", weights)
    assert base == [] and every == [("card", 6, 22), ("card", 23, 39)]


def test_clean_texts_stay_clean(weights):
    for text in ("version 2.0 of 1999 and 3.14", "chapter 12, verse 7", "room 101 (floor 3)", "no digits at all", "a @ b"):
        assert pii.find_spans(text, weights) == ([], [])


def test_decoding_is_the_best_segmentation(weights):
    """Dynamic programming against all segmentations of short regions."""
    for text in ("4111111111111111 4111111111111111", "+1 (988) 555-2485", "1.2.3.4 5.6.7.8", "a.b@c.de"):
        region = pii.region_of(text, 0, len(text))
        n = len(region.ends)
        spans = [(i, j, k, weights[f].sum()) for i, j, k, f in region.spans]
        plain = [weights[f].sum() for f in region.plain]
        best, chosen = -np.inf, None
        for size in range(4):
            for some in itertools.combinations(spans, size):
                some = sorted(some, key=lambda s: s[0])
                if any(a[1] > b[0] for a, b in zip(some, some[1:])):
                    continue
                value = sum(s[3] for s in some) + sum(plain[k] for k in range(n) if not any(s[0] <= k < s[1] for s in some))
                if value > best + 1e-9:
                    best, chosen = value, some
        clear = [(k, region.ends[i - 1] if i else 0, region.ends[j - 1]) for i, j, k, v in chosen if v - sum(plain[i:j]) >= pii.MARGIN]
        assert pii.decode(text, 0, len(text), weights) == clear


def test_gradient_is_of_the_likelihood():
    text = "pay 4111111111111111 now"
    (example,) = list(pii.examples_of("x " + text))[:1]
    region = pii.region_of(*example[:3])
    gold = {(i, j, k) for i, j, k, _ in region.spans if (k, region.start + (region.ends[i - 1] if i else 0), region.start + region.ends[j - 1]) in example[3]}
    weights = np.random.default_rng(1).normal(0, 0.1, pii.WEIGHTS)
    features = {}
    for span in [*[(i, j, k, f) for i, j, k, f in region.spans], *[(i, i + 1, None, f) for i, f in enumerate(region.plain)]]:
        features[span[:3]] = span[3]

    def log_likelihood(w):
        ways = [{0: [0.0]}]
        total = {0: [0.0]}
        for j in range(1, len(region.ends) + 1):
            total[j] = [v + w[f].sum() for (i, jj, _), f in features.items() if jj == j for v in total[i]]
        covered = {k for i, j, _ in gold for k in range(i, j)}
        value = sum(w[features[g]].sum() for g in gold) + sum(w[features[(k, k + 1, None)]].sum() for k in range(len(region.ends)) if k not in covered)
        return value - np.log(np.exp(np.array(total[len(region.ends)])).sum())

    change = pii.region_gradient(region, gold, weights)
    for at in list(change)[:12]:
        step = np.zeros(pii.WEIGHTS)
        step[at] = 1e-5
        assert change[at] == pytest.approx((log_likelihood(weights + step) - log_likelihood(weights - step)) / 2e-5, abs=1e-3)


def test_query_columns_and_masking(spark, weights, tmp_path):
    rows = list(enumerate(corpus()[:120] + ["", None]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for row in pii.op8_pii(spark, str(tmp_path)).collect():
        base = brute_base(rows[row["doc_id"]][1] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
    docs = spark.createDataFrame([(1, "mail a@b.co", 11), (2, None, None)], "doc_id long, text string, n_chars long")
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.mask_personal(docs, weights).collect()}
    assert masked == {1: ("mail <email>", 12), 2: (None, None)}


def test_long_runs_take_linear_time(weights):
    for text in ("1" * 200_000 + "@", "a" * 200_000 + "@b", "1." * 100_000, "+1" * 100_000, "a@" * 50_000, "1 " * 20_000):
        pii.base_spans(text)


def test_a_crowd_of_copies_leaves_the_other_regions_in_the_fit(spark, monkeypatch):
    """Copies of labelled regions are one example each; regions without spans and rare kinds stay."""
    used = []
    monkeypatch.setattr(pii, "fit", lambda examples: used.extend(examples))
    rows = ["call +1 (988) 555-2485 now"] * 300 + [f"mail u{i}@mail.example.com" for i in range(80)]
    rows += [f"version {i} of it" for i in range(30)] + ["pay 4111111111111111 now"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    pii.train(docs, 40)
    kinds = [{kind for kind, *_ in gold} for *_, gold in used]
    assert sum(not some for some in kinds) == 30 and sum(map(bool, kinds)) == 40
    assert {"card"} in kinds and 1 <= kinds.count({"phone"}) <= 2
    assert len({(text, start, end) for text, start, end, _ in used}) == len(used)
