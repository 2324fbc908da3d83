import datetime
import hashlib
import random

import duckdb
import regex
from pyspark.sql import functions as F

from tsflow.llm import pii
from tsflow.llm.queries import QUERIES

KEY = "k"
CANDIDATE = regex.compile(pii.CANDIDATE)


def permute(values, radixes, kind):
    h = len(values) // 2
    a, b, ra, rb = values[:h], values[h:], radixes[:h], radixes[h:]
    for r in range(1, pii.ROUNDS + 1):
        said = f"{KEY},{kind},{r}," + ".".join(map(str, b))
        new = [(x + int(hashlib.sha256(f"{said},{j}".encode()).hexdigest()[:13], 16) % n) % n for j, (x, n) in enumerate(zip(a, ra, strict=True))]
        a, b, ra, rb = b, new, rb, ra
    return a + b


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def mod97(s):
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97


def chars(s, kind, base=None):
    low = lambda c: "0" if c.isdigit() else "A" if c.isupper() else "a"
    syms = [c for c in s if c.isascii() and c.isalnum()]
    if base:
        out = [f"{v:x}" for v in permute([int(c, 16) for c in syms], [16] * len(syms), kind)]
    else:
        vs = permute([ord(c) - ord(low(c)) for c in syms], [10 if c.isdigit() else 26 for c in syms], kind)
        out = [chr(ord(low(c)) + v) for c, v in zip(syms, vs, strict=True)]
    it = iter(out)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in s)


def brute_one(m):
    """(kind or None, replacement)."""
    full = lambda p: regex.fullmatch(p, m)
    ints = [int(x) for x in regex.findall("[0-9]+", m)]
    if "@" in m:
        local, at, domain = m.partition("@")
        return "email", chars(local, "email") + at + domain
    if full(pii._SECRET):
        return "secret", chars(m, "secret", 16)
    if full(pii._IP):
        return ("ip", ".".join(map(str, permute(ints, [256] * 4, "ip")))) if max(ints) < 256 else (None, m)
    if full(pii._SSN):
        a, g, s = ints
        if not (0 < a < 900 and a != 666 and g and s):
            return None, m
        x, y, z = permute([a - 1 - (a > 666), g - 1, s - 1], [898, 99, 9999], "ssn")
        return "ssn", f"{x + 1 + (x + 1 >= 666):03d}-{y + 1:02d}-{z + 1:04d}"
    if full(pii._CARD):
        if not luhn(regex.sub("[^0-9]", "", m)):
            return None, m
        body = chars(m[:-1], "card")
        return "card", next(body + c for c in "0123456789" if luhn(regex.sub("[^0-9]", "", body + c)))
    if full(pii._DATE):
        a, b, c = ints
        for o, ymd in (("ymd", (a, b, c)), ("mdy", (c, a, b)), ("dmy", (c, b, a))):
            if (o == "ymd") != ("-" in m) or (o == "mdy" and "/" not in m):
                continue
            try:
                d = datetime.date(*ymd)
            except ValueError:
                continue
            if 1700 <= d.year <= 2099:
                day = (d - datetime.date(1700, 1, 1)).days
                x, y = permute([day // 773, day % 773], [189, 773], "date")
                n = datetime.date(1700, 1, 1) + datetime.timedelta(days=x * 773 + y)
                sep = "/" if "/" in m else "."
                return "date", n.isoformat() if o == "ymd" else n.strftime("%m/%d/%Y") if o == "mdy" else n.strftime(f"%d{sep}%m{sep}%Y")
        return None, m
    if full(pii._IBAN):
        plain = m.replace(" ", "")
        if len(plain) < 15 or mod97(plain) != 1:
            return None, m
        body = chars(m[4:], "iban")
        return "iban", f"{m[:2]}{98 - mod97(m[:2] + '00' + body.replace(' ', '')):02d}{body}"
    country = regex.match(r"\+[0-9]", m)
    return "phone", (country.group() if country else "") + chars(m[2:] if country else m, "phone")


def brute(rows):
    out = []
    for i, t in rows:
        n = dict.fromkeys(pii.KINDS, 0)

        def sub(x, n=n):
            kind, new = brute_one(x.group())
            if kind:
                n[kind] += 1
            return new
        out.append((i, None if t is None else CANDIDATE.sub(sub, t), *n.values()))
    return sorted(out, key=str)


def rows():
    r = random.Random(3)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts = [None, "", "plain", "a@b.co", "é.x@y.org ñ@z.com", "666-12-1234 000-11-2222 900-11-2222 899-99-9999 123-00-4567", "29/02/2023 29/02/2024 02/29/2024",
             "1.2.3.4.5 256.1.1.1 1.2.3.4", "1699-12-31 1700-01-01 2099-12-31 2100-01-01 2024-13-01", "GB82 WEST 1234 5698 7654 32", "GB83WEST12345698765432",
             "4111-1111-1111-1111 4111 1111 1111 1111, 4111111111111111 4111111111111112 378282246310005", "c7c44ab5d48cb8ca99c1afc0912391d7d2165884",
             "+4915112345678 (555) 123-4567 555-123-4567 +1 (743) 555-3824 123", "filler " * 50000 + "1.1.1.1"]
    for _ in range(300):
        texts.append(" ".join(r.choice([d(16), d(3) + "-" + d(2) + "-" + d(4), ".".join(d(r.randint(1, 3)) for _ in range(4)), f"{d(2)}/{d(2)}/{d(4)}",
                                        f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(1)}.19{d(2)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"x{d(2)}@m{d(1)}.example.com", "word,"]) for _ in range(8)))
    return [(i, t) for i, t in enumerate(texts)] + [(3, "1.2.3.4"), (None, "1.2.3.4")]


def test_matches_brute_force_and_goes_back(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").withColumns({"t": F.lit(1), "id": F.lit(2), "n_card": F.lit("z")})
    got = pii.pseudonymise(df, KEY)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows())
    iso = df.where("text NOT RLIKE '[0-9][/.][0-9]{1,2}[/.][0-9]{4}'")
    back = pii.pseudonymise(pii.pseudonymise(iso, KEY), KEY, back=True).select("doc_id", "text")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, iso.select("doc_id", "text").collect()), key=str)


def test_permutation_has_no_collisions(spark):
    days = spark.range(189 * 773).selectExpr("cast(id as int) AS d")
    v = F.array(F.floor(F.col("d") / 773).cast("int"), (F.col("d") % 773).cast("int"))
    new = days.select(pii.feistel(v, F.array(F.lit(189), F.lit(773)), "date", KEY).alias("v"))
    assert new.distinct().count() == 189 * 773


def test_empty(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    global KEY
    from tsflow.llm.queries import PII_KEY
    old, KEY = KEY, PII_KEY
    try:
        want = brute(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    finally:
        KEY = old
    assert sorted(map(tuple, QUERIES["op3_pii"](spark, sf).collect()), key=str) == want
