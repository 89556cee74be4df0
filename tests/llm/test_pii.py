"""Loose spellings of identifiers that the strict rules find elsewhere; the query on odd texts."""

import hashlib
import random
import re
from collections import Counter

from journalsieve.llm import pii, queries

RULES = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def accepted(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(part) <= 255 for part in found.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_loose_spelling_in_the_surroundings_of_its_seed(spark):
    numbers = [f"523-555-{1050 + k}" for k in range(8)]
    rows = [(k, f"please call hotline +1 {n} today") for k, n in enumerate(numbers)]
    rows.append((50, f"please call hotline 1 {numbers[5].replace('-', ' ')} today"))
    out = {r.id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not out[50].base and [(s.kind, s.start, s.end) for s in out[50].found] == [(3, 20, 34)]
    assert all(out[k].found == out[k].base and len(out[k].base) == 1 for k in range(8))


def test_query_equals_its_rules_on_odd_texts(spark, tmp_path):
    rng = random.Random(21)
    parts = ["a.b@c-d.ef", "x@y", "@", "1.2.3.4", "10.0.0.256", "007.0.0.1.5.6.7.8", "4111 1111-1111 1111", "4111111111111112",
             "+49 (30) 123-45.67", "+1", "+1 2 3 4 5 6 7 8 9 ", "0000000000000000", "\u0661.\u0662.3.4", "\U0001f600", "\u00e9",
             "\n", "\x00", " ", ".", "-", "a@b.c@d.e", "call", "mail [at] host.org", "(030) 1234567"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(300)]
    texts += [None, "", "b@c.de then a@b.cd", "1.2.3.4 5.6.7.8 x@y.z x@y.z", texts[3]]
    rows = [*enumerate(texts), (None, "x@y.zz +49 30 1234567"), (3, texts[3]), (3, "other 9.9.9.9")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = Counter()
    for doc_id, text in rows:
        spans = [(kind, *m.span()) for kind, rule in RULES for m in re.finditer(rule, text or "") if accepted(kind, m[0])]
        digest = hashlib.sha256(",".join(":".join(map(str, s)) for s in spans).encode()).hexdigest()
        wanted[doc_id, *(sum(s[0] == kind for s in spans) for kind, _ in RULES), digest] += 1
    out = queries.op3_bootstrapped_pii(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == wanted
