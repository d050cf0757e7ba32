import base64
import hashlib
import random
import re

from riskweave.llm import license_scan as C
from riskweave.llm import secret_scan as S

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scanned(df):
    return S.scan_secrets(df).select("doc_id", S.joined_spans(S.KINDS[:3]).alias("base"), S.joined_spans(S.KINDS).alias("spans"))


def test_secrets_against_brute_force(spark):
    random.seed(5)
    parts = ["password", "=", ": ", "TOKEN", "'", '"', "abc123xyz", "secret=token:abcdefgh", " ", "AKIA", "ABCDEFGH12345678XYZ", "0123456789abcdef", "é", "😀", "api_key", "apikey=", "\n"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randrange(1, 25)))) for i in range(400)]
    got = {r.doc_id: r.base for r in scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: base_spans(t) for i, t in rows}


def test_random_runs_are_added(spark):
    rng = random.Random(6)
    words = "internationalization counterrevolutionaries well_known_configuration_names path/to/some/longer/file AAAAAAAAAAAAAAAAAAAAAAAA1 abcdefghijklmnopqrstuvwxyz012345".split()
    rows = []
    for i in range(200):
        run = base64.b64encode(rng.randbytes(30)).decode() if i % 10 == 0 else rng.choice(words)
        rows.append((i, f"é before {run} after"))
    found = {r.doc_id for r in scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect() if "random" in r.spans}
    assert len([i for i in found if i % 10 == 0]) >= 18 and not [i for i in found if i % 10]


TOKENS = {
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz", "UPPER": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "decimal": "0123456789",
}


def test_random_tokens_of_every_encoding(spark):
    """Recall of planted tokens by encoding and length; decimal ones of 24 digits and more are hex spans."""
    from tests.llm.conftest import PROSE

    rng = random.Random(11)
    long_words = "internationalization counterrevolutionaries well_known_configuration_names path/to/some/longer/file INTERNATIONALIZATION getElementByIdFromHashTable 20240131123000000000".split()
    rows, kind = [], {}
    for name, letters in TOKENS.items():
        for n in (20, 26, 32, 40, 52):
            for _ in range(20):
                token = "".join(rng.choice(letters) for _ in range(n))
                kind[len(rows)] = (name, n)
                rows.append((len(rows), f"{PROSE} {PROSE.upper()} Room 12 of 345, {token} {rng.choice(long_words)}", token))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found, wrong = {}, []
    for r in S.scan_secrets(docs).collect():
        text, token = rows[r.doc_id][1:]
        for s in r.random + r.hex:
            wrong += [text[s.start : s.stop]] * (text[s.start : s.stop] != token)
            found[kind[r.doc_id]] = found.get(kind[r.doc_id], 0) + (text[s.start : s.stop] == token)
    recall = {k: found.get(k, 0) / 20 for k in sorted(set(kind.values()))}
    assert not wrong
    for name in TOKENS:
        every = [recall[name, n] for n in (20, 26, 32, 40, 52)]
        assert min(every) >= 0.8 and sum(every) >= 4.5, (name, every)


def test_secrets_in_odd_rows(odd, none):
    rows = scanned(odd).collect()
    assert len(rows) == odd.count() and all(r.base == "" for r in rows)
    assert scanned(none).count() == 0
    assert hashlib.sha256(b"").hexdigest() == odd.sparkSession.sql("select sha2('', 256) s").first().s


def brute_licenses(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]
    have = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    out = set()
    for name, template in C.TEMPLATES:
        w = [x for x in re.split(r"[^a-z0-9]+", template.lower()) if x]
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if own and len(own & have) >= 0.8 * len(own):
            out.add(name)
    return out


def test_licenses_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 400))]
        for _ in range(rng.randrange(0, 3)):
            notice = rng.choice(C.TEMPLATES)[1].upper().split()
            if rng.random() < 0.3:
                notice[0] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        rows.append((i, " ".join(words)))
    got = {}
    for r in C.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.containment >= 0.8
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {i: x for i, t in rows if (x := brute_licenses(t))}


def test_licenses_in_odd_rows(odd, none):
    assert C.scan_licenses(odd).count() == 0 and C.scan_licenses(none).count() == 0
    # the band count is what the probability asks for
    assert 1 - (1 - C.LEAST_JACCARD**C.ROWS) ** C.BANDS >= C.COLLISION
