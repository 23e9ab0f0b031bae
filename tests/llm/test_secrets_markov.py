"""The secret scan, its Markov chains included, against a plain version in Python."""

import base64
import collections
import hashlib
import math
import random
import re

from runlens.llm import secrets_markov as s


def matches(pattern, text):
    return list(re.finditer(pattern, text, re.ASCII))


def plain_model(texts):
    secret, words = [], set()
    for t in texts:
        secret += [m[2] for m in matches(s.ASSIGN, t)] + [m[0] for p in (s.ACCESS, s.HEX) for m in matches(p, t)]
        for p in (s.ASSIGN, s.ACCESS, s.HEX):
            t = re.sub(p, " ", t, flags=re.ASCII)
        words |= {m[0] for m in matches(s.WORD, t) if len(m[0]) < s.LONG}
    secret = [x for x in secret if len(x) >= 12]
    for i in range(s.RANDOM):
        d = hashlib.sha512(f"random string {i}".encode())
        b = base64.b64encode(d.digest()).decode()
        secret += [d.hexdigest()[:40], b[:40], re.sub("[^A-Z0-9]", "", b.upper())[:24]]
    signs = ["", *s.ALPHABET]

    def chain(tokens):
        pairs = collections.Counter(p for t in tokens for p in zip(t, t[1:], strict=False))
        first, second = collections.Counter(), collections.Counter()
        for (a, b), n in pairs.items():
            first[a] += n
            second[b] += n
        total = sum(s.PSEUDO + second[b] for b in signs)
        return {(a, b): math.log((pairs[a, b] + s.LEAN * (s.PSEUDO + second[b]) / total) / (first[a] + s.LEAN)) for a in signs for b in signs}

    odd, usual = chain(secret), chain(words)
    return {p: odd[p] - usual[p] for p in odd}


def plain_spans(text, model):
    base = [(m.start(), k, m.end()) for k, p in enumerate((s.ASSIGN, s.ACCESS, s.HEX)) for m in matches(p, text) if k or len(m[2]) >= s.ASSIGN_LEAST]
    out = list(base)
    for m in matches(s.TOKEN, text):
        score = sum(model[p] for p in zip(m[0], m[0][1:], strict=False))
        if score > s.TOTAL and score > s.MEAN * (len(m[0]) - 1) and all(e <= m.start() or a >= m.end() for a, _, e in base):
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{s.KINDS[k]}:{a}:{e}" for a, k, e in sorted(out))


def made_texts():
    rng = random.Random(5)
    words = "loader config retry_count maximum-value the quick brown river getUserName handle_request_body a/path/to/some/module.py".split()
    signs = s.ALPHABET[:62]

    def token(kind):
        key = "".join(rng.choices(signs, k=rng.randint(8, 60)))
        return {0: key, 1: f"password = '{key}'", 2: "AKIA" + "".join(rng.choices(signs[:26] + "0123456789", k=rng.randint(10, 20))), 3: "".join(rng.choices("0123456789abcdef", k=rng.randint(16, 48))), 4: f"Api_Key:{key[:5]}", 5: "_".join(rng.sample(words[:8], 4)), 6: f"é{key}\U0001f600"}[kind]

    texts = [rng.choice([" ", "\n", ", "]).join(token(rng.randrange(7)) if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return [*texts, "", None, "x" * 20_000, texts[0]]


def test_scan_equals_a_plain_version(spark):
    texts = made_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = plain_model([t for t in texts if t])
    got = {r.doc_id: r.spans for r in s.secrets(docs).collect()}
    want = {k: plain_spans(t or "", model) for k, t in enumerate(texts)}
    assert got == want
    assert sum("markov" in x for x in want.values()) > 30 and sum("markov" not in x for x in want.values()) > 5
