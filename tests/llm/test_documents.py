"""op3, op4, op8, op9, op10 against brute force, planted cases and held-out labels."""

import contextlib
import datetime
import hashlib
import io
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veldra.llm import entries, labelled, license_scan, pii, quality, simhash, toxicity
from veldra.llm.components import connected
from veldra.llm.license_texts import TEMPLATES

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DIR}/labels.parquet")


# PII


def feistel(left, right, m, n, key, kind):
    for i in range(1, pii.ROUNDS + 1):
        value = int(hashlib.sha256(f"{key}|{kind}|{i}|{right}".encode()).hexdigest()[:15], 16)
        left, right, m, n = right, (left + value % m) % m, n, m
    return left, right


def luhn(digits):
    return sum(int(c) * 2 // 10 + int(c) * 2 % 10 if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def card(number, key):
    body = number[:-1]
    half = len(body) // 2
    left, right = feistel(int(body[:half]), int(body[half:]), 10**half, 10 ** (len(body) - half), key, "card")
    made = f"{left:0{half}d}{right:0{len(body) - half}d}"
    return next(made + str(c) for c in range(10) if luhn(made + str(c)))


def check_masked(spark, wanted):
    """``wanted``: pairs of a text and what it becomes, by one job."""
    got = pii.mask(documents(spark, [(k, text, "s") for k, (text, _) in enumerate(wanted)]), "K").orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [made for _, made in wanted]


def test_cards(spark):
    number = "4417744280351547"
    new = card(number, "K")
    grouped = lambda x, s: s.join(x[k : k + 4] for k in range(0, 16, 4))
    text = f"a 12 {number}, {grouped(number, '-')} | 7 {grouped(number, ' ')}\n{number}. 9807915762804490 {number} 12345"
    assert luhn(new)
    wanted = [(text, f"a 12 {new}, {grouped(new, '-')} | 7 {grouped(new, ' ')}\n{new}. 9807915762804490 {new} 12345")]
    rng = random.Random(1)
    for n in (13, 15, 19):
        number = next(x for x in iter(lambda n=n: str(rng.randrange(10 ** (n - 1), 10**n)), None) if luhn(x))
        wanted.append((number, card(number, "K")))
    check_masked(spark, wanted)


def codes():
    """Valid area and exchange codes in order."""
    return [c for c in range(200, 1000) if c % 100 != 11]


def telephone(digits, key):
    known = codes()
    number = (known.index(int(digits[:3])) * 792 + known.index(int(digits[3:6]))) * 10**4 + int(digits[6:])
    left, right = feistel(number // 79200, number % 79200, 79200, 79200, key, "phone")
    high, line = divmod(left * 79200 + right, 10**4)
    return f"{known[high // 792]}{known[high % 792]}{line:04d}"


def address_of(mail, key):
    digest = hashlib.sha256(f"{key}|mail|{mail.lower()}".encode()).hexdigest()
    left, right = feistel(int(digest[:8], 16), int(digest[8:16], 16), 2**32, 2**32, key, "mail")
    return f"u{left:08x}{right:08x}@example.invalid"


def test_addresses_telephones_mail(spark):
    left, right = feistel(161 * 256 + 17, 88 * 256 + 162, 65536, 65536, "K", "ip")
    d = telephone("3775550271", "K")
    one, two = address_of("an.5@mail3.example.com", "K"), address_of("Ñ.1@x.org", "K")
    wanted = [
        ("ip 161.17.88.162, 300.1.1.1 1.2.3.4.5 v1.2.3.4", f"ip {left >> 8}.{left & 255}.{right >> 8}.{right & 255}, 300.1.1.1 1.2.3.4.5 v1.2.3.4"),
        ("+1 (377) 555-0271%%% +1 377 555 0271.", f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}%%% +1 {d[:3]} {d[3:6]} {d[6:]}."),
        ("an.5@mail3.example.com, ñ.1@x.org AN.5@MAIL3.EXAMPLE.COM!! a@b", f"{one}, {two} {one}!! a@b"),
    ]
    wanted += [(x, x) for x in ("+1 011 000 0000", "+1 (311) 555-0271", "+1 212 911 0000", "+1 212 111 0000")]
    wanted += [(f"+1{x}", f"+1{telephone(x, 'K')}") for x in ("2002000000", "9999999999", "2102120001")]
    check_masked(spark, wanted)


def test_runs_of_groups(spark):
    """A number may begin at any group of a run."""
    new = card("4417744280351547", "K")
    four = " ".join(new[k : k + 4] for k in range(0, 16, 4))
    left = "4417 7442 8035 1547"
    wanted = [(f"in 2023 {left} 7", f"in 2023 {four} 7"), (f"{left} 12abc", f"{four} 12abc"), (f"{left} 2.5", f"{four} 2.5"), ("4417 7442-8035 1547", "4417 7442-8035 1547"), (f"{left} " * 300 + "12", f"{four} " * 300 + "12")]
    rng = random.Random(5)
    for sizes in ((4, 4, 4, 4, 1), (4, 4, 4, 4, 3), (4, 6, 4), (4, 6, 5), (4, 4, 4, 7)):
        n = sum(sizes)
        number = next(x for x in iter(lambda n=n: str(rng.randrange(10 ** (n - 1), 10**n)), None) if luhn(x))
        ends = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
        wanted += [tuple(mark.join(x[a:b] for a, b in zip(ends, ends[1:], strict=False)) for x in (number, card(number, "K"))) for mark in " -"]
    check_masked(spark, wanted)


def test_the_key_is_in_no_plan(spark):
    out, frame = io.StringIO(), pii.mask(documents(spark, [(1, "4417744280351547", "s")]), "a very secret key")
    with contextlib.redirect_stdout(out):
        for mode in ("extended", "formatted", "codegen"):
            frame.explain(mode)
    assert frame.first()["text"] == card("4417744280351547", "a very secret key") and "secret" not in out.getvalue()
    assert len(entries.pii_key(spark)) == 64 and entries.pii_key(spark) == entries.pii_key(spark)  # drawn once


def test_dates(spark):
    day = datetime.date(1987, 3, 14)
    at = (day - datetime.date(1940, 1, 1)).days
    left, right = feistel(at // 487, at % 487, 75, 487, "K", "date")
    new = datetime.date(1940, 1, 1) + datetime.timedelta(left * 487 + right)
    early, late = (datetime.date(1, 1, 1), 14244, 12, 1187), (datetime.date(9940, 1, 1), 21915, 45, 487)
    wanted = [("d 1987-03-14 14/03/1987 14.3.1987 1987-02-30 30/2/1987 1987-3-14 0000-01-01", f"d {new} {new:%d/%m/%Y} {new:%d}.{new.month}.{new.year} 1987-02-30 30/2/1987 1987-3-14 0000-01-01")]
    for (first, _, tall, wide), old in ((early, datetime.date(39, 12, 31)), (late, datetime.date(9999, 12, 31))):
        left, right = feistel((old - first).days // wide, (old - first).days % wide, tall, wide, "K", "date")
        moved = first + datetime.timedelta(left * wide + right)
        wanted += [(old.isoformat(), moved.isoformat()), (f"123456 {old.isoformat()}", f"123456 {moved.isoformat()}"), (f"{old.day}/{old.month}/{old.year:04d}", f"{moved.day:02d}/{moved.month:02d}/{moved.year:04d}")]
    check_masked(spark, wanted)


def test_permutations(spark):
    for days, year in ((36525, 1940), (36524, 1840), (14244, 1), (21915, 9940)):
        first = datetime.date(year, 1, 1)
        moved = spark.range(days).select(pii._move_day(F.date_add(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.col("id").cast("int")), "K").alias("d")).distinct()
        assert tuple(moved.agg(F.count("*"), F.min("d"), F.max("d")).first()) == (days, first, first + datetime.timedelta(days - 1))
    for n in (2, 3):
        digits = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        assert digits.select(pii.permute_digits(F.col("d"), "K", "x").alias("e")).distinct().count() == 10**n


def test_pii_edges(spark):
    rows = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "no number", 3), (2, "no number", 3), (3, "4417744280351547 " * 500, 4)], "doc_id long, text string, `l.r` int")
    out = pii.mask(rows, "K")
    assert out.columns == rows.columns and [r["text"] for r in out.collect()][:4] == [None, "", "no number", "no number"]
    assert out.collect()[4]["text"] == f"{card('4417744280351547', 'K')} " * 500
    assert pii.mask(rows.limit(0), "K").collect() == []


# licenses


def contained(text):
    """Of each template, share and first word of its best window."""
    words, out = license_scan.words_of(text), {}
    for name, template in TEMPLATES.items():
        w = license_scan.words_of(template)
        size = min(5, len(w))
        own = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        here, step = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)], 2 ** int(math.log2(len(own)))
        best = (0.0, 0, 0)
        for begin in range(0, len(here), step):
            at = [k for k in range(begin, min(begin + 4 * step, len(here))) if here[k] in own]
            share = len({here[k] for k in at}) / len(own)
            if share > best[0]:
                best = (share, at[0], at[-1] - at[0] + size)
        if best[0] >= 0.8:
            out[name] = best
    return out


def test_licenses_against_brute_force(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    wanted = {(k, name, *best) for k, t in texts.items() for name, best in contained(t).items()}
    assert {tuple(r) for r in license_scan.scan_licenses(docs, TEMPLATES).collect()} == wanted and {"All rights reserved", "MIT notice"} <= {w[1] for w in wanted}


def scanned(scanner, text):
    return {m[0]: m[1:] for m in scanner.scan(text)}


def test_license_near_copies():
    scanner, rng = license_scan.Scanner(TEMPLATES), random.Random(3)
    filler = [f"w{rng.randrange(999)}" for _ in range(400)]
    for name, template in TEMPLATES.items():
        for _ in range(20):
            words = template.split()
            for _ in range(len(words) // 40):
                words[rng.randrange(len(words))] = "changed"
            at = rng.randrange(len(filler))
            text = " ".join(filler[:at] + words + filler[at:])
            assert scanned(scanner, text) == contained(text), name


def test_passages_split_over_windows():
    """Both halves of a template count if a window holds them; farther apart they don't add up."""
    scanner, rng = license_scan.Scanner(TEMPLATES), random.Random(4)
    filler = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    seen = set()
    for name in TEMPLATES:
        words = TEMPLATES[name].split()
        for gap in (0, 1, 10, 60, 300, 400, 3000):
            text = f"{filler(rng.randrange(40))} {' '.join(words[: len(words) // 2])} {filler(gap)} {' '.join(words[len(words) // 2 :])} {filler(50)}"
            found = scanned(scanner, text)
            assert found == contained(text), (name, gap)
            seen.add((name == "MIT grant" and gap, "MIT grant" in found))
    assert {(0, True), (60, True), (400, False), (3000, False)} <= seen
    twice = f"{' '.join(TEMPLATES['MIT grant'].split()[:90])} {filler(700)} {TEMPLATES['MIT grant']} {TEMPLATES['MIT grant']}"
    assert scanned(scanner, twice) == contained(twice) and scanned(scanner, twice)["MIT grant"][0] == 1.0


def test_license_sql_agrees(spark):
    """On passages cut in two, edited and repeated, with null, empty and repeated rows."""
    import duckdb

    rng, rows = random.Random(9), [(None, None), (1, ""), (2, "Released under the MIT"), (3, "x ALL  rights, reserved"), (3, "x ALL  rights, reserved")]
    for name in TEMPLATES:
        words = TEMPLATES[name].split()
        for gap in (0, 5, 400):
            filler = [f"w{rng.randrange(99)}" for _ in range(gap)]
            edited = ["zz" if rng.random() < 0.02 else w for w in words]
            rows.append((len(rows), " ".join(edited[: len(words) // 3] + filler + edited[len(words) // 3 :] + filler + (words if gap else []))))
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    frame = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, license string, containment double")
    found = license_scan.scan_licenses(frame, TEMPLATES).select("doc_id", "license", "containment", "first_word")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, duck.execute(entries.license_sql()).fetchall()))


def test_license_bands_and_edges(spark):
    least = license_scan.least_similarity(1, 0.8)
    assert (1 - least) ** license_scan.bands(0.8, 1e-6) <= 1e-6
    rows = documents(spark, [(1, None, "s"), (2, "", "s"), (3, "Released under the MIT", "s"), (None, "RELEASED under the MIT License!!", "s"), (4, "x. " * 9000 + TEMPLATES["MIT notice"], "s"), (4, TEMPLATES["MIT notice"] * 2, "s")])
    got = sorted((str(r["doc_id"]), r["license"], r["containment"], r["first_word"]) for r in license_scan.scan_licenses(rows, TEMPLATES).collect())
    assert got == [("4", "MIT notice", 1.0, 0), ("4", "MIT notice", 1.0, 9000), ("None", "MIT notice", 1.0, 0)]
    assert license_scan.scan_licenses(rows.limit(0), TEMPLATES).collect() == []
    with pytest.raises(ValueError, match="no words"):
        license_scan.Scanner({"x": "..."})


# SimHash


def slow_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, distance):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    rows += [(1000 + k, t.replace(" the ", " a ", 1), s) for k, (_, t, s) in enumerate(rows)] + [(2000, "", "s"), (2001, " \n", "s"), (2002, "One", "s"), (2003, "one", "s"), (2004, "a b\x1cc É", "s")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    fps = {k: slow_fingerprint(t) for k, t, _ in rows}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{f:016x}" for k, f in fps.items()}
    root, least = roots(fps.values(), 4), {}
    for k in sorted(fps):
        least.setdefault(root[fps[k]], k)
    assert {k: r["component_id"] for k, r in got.items()} == {k: least[root[f]] for k, f in fps.items()}


@pytest.mark.parametrize(("distance", "block", "crowd"), [(4, 2048, 64), (4, 20, 64), (4, 2048, 1e-4), (4, 20, 1e-8), (3, 2048, 64), (3, 2048, 0), (1, 2048, 64), (1, 2048, 0), (0, 2048, 64)])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, distance, block, crowd):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(distance)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for k in range(400):  # clusters and chains at and just over the distance
        base, moved = (fps[0] if k % 3 == 0 else rng.choice(fps)), rng.sample(range(64), rng.choice([1, distance, distance + 1]) or 1)
        fps.append(base ^ sum(1 << b for b in moved))
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    pairs = simhash.links(spark.createDataFrame(signed, "fp long"), distance)
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in pairs.collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in found)
    parent = {r["node"] % 2**64: r["root"] % 2**64 for r in connected(pairs).collect()}
    by = {}
    for f, r in roots(fps, distance).items():
        by.setdefault(r, set()).add(parent.get(f, f))
    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)


def test_chains_cover_every_close_pair():
    rng = random.Random(7)
    chains = [simhash.chain_masks(k, 4) for k in range(5)]
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        starts = [k for k, c in enumerate(chains) if all((x & int(m)).bit_count() <= n for m, n in c)]
        parts = simhash.segments(4)
        assert any((x & (((1 << parts[k][1]) - 1) << parts[k][0])) == 0 for k in starts)


def test_keys_widen_with_the_number_of_fingerprints():
    assert [simhash.key_length(n, 4) for n in (0, 10**7, 10**8, 10**9, 10**10, 10**13)] == [2, 2, 3, 3, 4, 4]
    assert [len(simhash.key_parts(4, k)) for k in (2, 3, 4)] == [10, 25, 75]
    rng = random.Random(8)
    for length in (2, 3, 4):
        kinds = simhash.key_parts(4, length)
        masks = [sum(((1 << w) - 1) << at for at, w in found) for found in kinds]
        assert min(m.bit_count() for m in masks) >= 6 * (length + 1)
        for _ in range(3000):  # every pair within the distance has a key in common
            x = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
            assert any(not x & m for m in masks)


def test_a_very_long_text():
    text = " ".join(f"w{k % 977} q{k % 31}" for k in range(150_000))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(2, 41)}, 200: 100, 150: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("limit", [200_000, 0])
def test_deduplicate(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", limit)
    text = " ".join(f"word{k}" for k in range(300))
    rows = [(5, text, "s"), (3, text, "t"), (9, text.replace("word7 ", "other "), "s"), (3, text, "t"), (4, "something else altogether here", "s"), (None, "no id but a text", "s"), (6, None, "s"), (7, "", "s")]
    docs = documents(spark, rows)
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["source"]) for r in got.collect()) == [("3", "t"), ("4", "s"), ("6", "s"), ("None", "s")]
    assert simhash.deduplicate(docs.limit(0)).collect() == []


# quality


def test_quality_on_held_out_labels(spark, docs, labels):
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    truth = {r["doc_id"]: r["quality"] for r in test.collect()}
    keep = {r["doc_id"]: r["keep"] for r in quality.score(docs, train).select("doc_id", "keep").collect()}
    assert np.mean([bool(truth[k]) == keep[k] for k in truth]) >= 0.97
    assert all(keep[k] for k in truth if truth[k])


def slow_shifts(rows):
    """Of (host, path, p): each row's shift, by the formulas of a nested analysis of variance, in plain Python."""
    rows = [(h, x, round(p * 2**30) / 2**30) for h, x, p in rows]
    n, mean = len(rows), min(max(sum(r[2] for r in rows) / len(rows), 1e-3), 1 - 1e-3)
    paths, hosts = {}, {}
    for h, x, p in rows:
        paths.setdefault((h, x), []).append(p)
        hosts.setdefault(h, []).append(p)
    avg = lambda v: sum(v) / len(v)
    total = sum(r[2] for r in rows) / n
    within = sum((p - avg(v)) ** 2 for v in paths.values() for p in v)
    between_paths = sum(len(v) * (avg(v) - avg(hosts[h])) ** 2 for (h, _), v in paths.items())
    between_hosts = sum(len(v) * (avg(v) - total) ** 2 for v in hosts.values())
    single = within / max(n - len(paths), 1)
    shares = sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in paths.items())
    room = n - shares
    by_path = max((between_paths - (len(paths) - len(hosts)) * single) / room, 1e-6) if room > 1e-9 else 1e-6
    room = n - sum(len(v) ** 2 for v in hosts.values()) / n
    by_host = max((between_hosts - (len(hosts) - 1) * single - by_path * (shares - sum(len(v) ** 2 for v in paths.values()) / n)) / room, 1e-6) if room > 1e-9 else 1e-6
    a, b = (max(mean * (1 - mean) / t - 1, 1.0) for t in (by_host, by_path))
    out = []
    for h, x, p in rows:
        host = (sum(hosts[h]) - p + a * mean) / (len(hosts[h]) - 1 + a)
        path = min(max((sum(paths[h, x]) - p + b * host) / (len(paths[h, x]) - 1 + b), 1e-3), 1 - 1e-3)
        out.append(math.log(path / (1 - path)) - math.log(mean / (1 - mean)))
    return out


def test_site_posteriors(spark):
    """Against plain Python, for sites alike and apart."""
    rng = random.Random(2)
    cases = [[("h1", "h1/a", 0.9)] * 50 + [("h1", "h1/b", 0.1)] + [("h2", "h2/a", 0.2)] * 50 + [("h3", "h3/a", 0.0)], [("h", "h/a", 0.5)] * 3, [("h", "h/a", 0.7)]]
    for spread in (0.0, 0.2, 0.4):
        rows = []
        for h in range(12):
            host = 0.5 + spread * rng.uniform(-1, 1)
            for x in range(rng.randrange(1, 5)):
                path = min(max(host + spread * rng.uniform(-0.5, 0.5), 0), 1)
                rows += [(f"h{h}", f"h{h}/{x}", min(max(path + rng.uniform(-0.1, 0.1), 0.0), 1.0)) for _ in range(rng.randrange(1, 40))]
        cases.append(rows)
    for rows in cases:
        frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, host__ string, path__ string, p__ double")
        known, priors = quality.sites(frame)
        names = {x: x for x in ("n", "s", "hn", "hs")}
        got = frame.join(known, "path__").select("k", priors.shift(F.col("p__"), names).alias("x")).orderBy("k").collect()
        assert [r["x"] for r in got] == pytest.approx(slow_shifts(rows), abs=1e-4)


def test_scores_follow_from_documents_and_sites(spark, docs, labels):
    got = quality.score(docs, labels).collect()
    logistic = lambda x: 1 / (1 + math.exp(-x))
    shifts = slow_shifts([(r["host"], f"{r['host']}/{r['path']}", logistic(r["document_logit"])) for r in got])
    assert [r["site_shift"] for r in got] == pytest.approx(shifts, abs=1e-3)
    assert all(r["quality"] == pytest.approx(logistic(r["document_logit"] + r["site_shift"])) and r["keep"] == (r["quality"] >= 0.5) for r in got)


def test_the_sample_is_bounded(spark):
    """One row of each doc_id, whatever number of rows it has."""
    docs = spark.range(5000).selectExpr("id % 3 as doc_id", "cast(id as string) as text")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, 1), (9, 1)], "doc_id long, quality int")
    assert sorted((r["doc_id"], r["label"]) for r in labelled.sample(docs, labels, "quality").collect()) == [(0, 1), (1, 0), (2, 1)]
    assert labelled.sample(docs, labels, "quality", 2).count() == 2
    same = [labelled.sample(docs.repartition(n), labels, "quality").orderBy("doc_id").collect() for n in (1, 7)]
    assert same[0] == same[1]


CLASHES = ["salt", "salt_", "key", "n", "s", "hn", "hs", "path__", "at", "logit", "shift", "pii_key", "row_key", "row_number", "salt___", "k"]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_clashing_columns(spark, docs, labels, monkeypatch, limit):
    """Columns with the names that operators use inside come back as they are."""
    monkeypatch.setattr(quality, "BROADCAST_SITES", limit)
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", limit)
    rows = docs.select("*", *[F.lit(700 + k).alias(c) for k, c in enumerate(CLASHES)])
    for keep in (lambda d: quality.keep_good(d, labels), lambda d: toxicity.keep_civil(d, labels), simhash.deduplicate, lambda d: pii.mask(d, "K")):
        out = keep(rows)
        assert out.columns == rows.columns
        values = out.select(*CLASHES).distinct().collect()
        assert [tuple(r) for r in values] == [tuple(range(700, 700 + len(CLASHES)))]


def test_quality_edges(spark, docs, labels):
    rows = documents(spark, [(1, None, None), (2, "", ""), (3, "The cat sat on the mat, and so on. It was good.", "https://h/p/x"), (3, "The cat sat on the mat, and so on. It was good.", "https://h/p/x"), (None, "Text. " * 5000, "h/p")]).withColumn("salt__", F.lit(1)).withColumn("path__", F.lit("x"))
    none = labels.limit(0)
    got = quality.score(rows, none).collect()
    assert len(got) == 5 and all(r["keep"] for r in got) and {r["host"] for r in got} == {"", "h"}
    assert quality.keep_good(rows, none).columns == rows.columns and quality.keep_good(rows, none).count() == 5
    assert quality.keep_good(rows.limit(0), none).collect() == []
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in quality.score(docs, labels).where("keep").collect()}


def test_sites_joined_by_shuffle(spark, docs, labels, monkeypatch):
    wanted = sorted(r["doc_id"] for r in quality.keep_good(docs, labels).collect())
    scores = sorted(tuple(r) for r in quality.score(docs, labels).collect())
    monkeypatch.setattr(quality, "BROADCAST_SITES", 2)
    assert sorted(r["doc_id"] for r in quality.keep_good(docs, labels).collect()) == wanted
    assert sorted(tuple(r) for r in quality.score(docs, labels).collect()) == scores


# toxicity


def test_toxicity_on_held_out_labels(spark, docs):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    got = toxicity.score(docs, train).join(test.select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    bad, good = [r for r in got if r["truth"]], [r for r in got if not r["truth"]]
    assert np.mean([r["toxic"] for r in good]) < 0.01
    assert np.mean([r["toxic"] for r in bad]) > 0.85  # some labels are noise: texts without any marked word
    assert np.mean([r["expected_severity"] for r in bad]) > 1 > 0.2 > np.mean([r["expected_severity"] for r in good])


def slow_likelihood(theta, x, grades, levels, penalty):
    """Row by row, from the definition."""
    d = x.shape[1]
    cuts = [theta[d]]
    for raw in theta[d + 1 :]:
        cuts.append(cuts[-1] + math.log1p(math.exp(raw)))
    below = lambda k, z: 0.0 if k < 0 else 1.0 if k >= levels - 1 else 1 / (1 + math.exp(z - cuts[k]))
    total = sum(math.log(below(g, float(r @ theta[:d])) - below(g - 1, float(r @ theta[:d]))) for r, g in zip(x, grades, strict=True))
    return total / len(x) - penalty * sum(theta[:d] ** 2) / 2


def test_likelihood_and_gradient():
    rng = np.random.default_rng(1)
    x, grades = rng.poisson(0.7, (40, 5)).astype(float), rng.integers(0, 4, 40)
    for theta in (np.array([0.3, 0.1, 0.5, 0.0, 0.2, -1.0, 0.4, -0.5]), rng.normal(size=8)):
        value, gradient = toxicity.likelihood(theta, toxicity.sparse(x), grades, 4, 0.01)
        assert value == pytest.approx(slow_likelihood(theta, x, grades, 4, 0.01))
        for k in range(8):
            step = np.eye(8)[k] * 1e-6
            slope = (slow_likelihood(theta + step, x, grades, 4, 0.01) - slow_likelihood(theta - step, x, grades, 4, 0.01)) / 2e-6
            assert gradient[k] == pytest.approx(slope, abs=1e-6)


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.poisson(1.0, (3000, 3)).astype(float)
    z = x @ np.array([2.0, 1.0, 0.0]) + rng.logistic(size=3000)
    grades = (z[:, None] > np.array([2.0, 4.0])[None, :]).sum(axis=1)
    weights, thresholds = toxicity.fit_ordinal(toxicity.sparse(x), grades, 3)
    assert np.allclose(weights, [2, 1, 0], atol=0.25) and np.allclose(thresholds, [2, 4], atol=0.4)
    model = toxicity.Ordinal(toxicity.Marks(["bad", "worse*"]), np.array([0.5, 1.0, 2.0]), np.array([1.0, 2.0]))
    severity, p = model.assess(["", "bad", "bad BAD", "worsening bad bad"])
    assert list(severity) == sorted(severity) and (p <= severity).all() and severity[0] == pytest.approx(1 / (1 + np.e) + 1 / (1 + np.e**2))


def test_grades():
    odds = np.array([5.0, 1.0, 2.0, 3.0, 9.0, 4.0, 0.5])
    assert toxicity.graded(np.array([0, 1, 1, 1, 0, 1, 1]), odds).tolist() == [0, 1, 2, 3, 0, 3, 1]
    assert toxicity.graded(np.array([0, 1, 2, 1, 0, 1, 2]), odds).tolist() == [0, 1, 2, 1, 0, 1, 2]
    assert toxicity.graded(np.array([0, 1, 1, 1]), np.zeros(4)).tolist() == [0, 1, 1, 1]  # ties
    rng = np.random.default_rng(3)
    x = rng.poisson(1.0, (400, 2)).astype(float)
    toxic, half = x[:, 0] > 1, np.arange(400) % 2
    crossed = toxicity.crossed_odds(half, toxic, [toxicity.sparse(x)] * 2)
    for h in (0, 1):
        own = toxicity.fit_ordinal(toxicity.sparse(x[half == h]), toxic[half == h].astype(int), 2)[0]
        assert np.allclose(crossed[half != h], x[half != h] @ own)
    assert not toxicity.crossed_odds(half, half == 0, [toxicity.sparse(x)] * 2).any()


def test_all_marks_count(spark):
    """There is no limit to their number."""
    words = [f"x{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100 % 10]}{'abcdefghij'[k // 1000]}q" for k in range(2600)]
    rows = documents(spark, [(k, " ".join([f"u{chr(97 + k % 26)}{chr(97 + k // 26)}", *(random.Random(k).sample(words, 2600) if k % 4 == 0 else ["fine"])]), "s") for k in range(120)])
    model = toxicity.fit(rows, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)], "doc_id long, toxic int"))
    assert {*words} <= {*model.marks.names}


def test_toxicity_edges(spark):
    rows = documents(spark, [(k, ("you idiot " if k % 4 == 0 else "you there ") + " ".join(f"{c}{chr(97 + k // 26)}{chr(97 + k % 26)}" for c in "wxyz"), "s") for k in range(200)] + [(None, None, "s"), (500, "", "s"), (501, "idiot " * 20000, "s")])
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(200)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(rows, labels).collect()}
    assert [k for k in range(200) if got[k]["toxic"]] == list(range(0, 200, 4)) and got[501]["toxic"] and not got[500]["toxic"] and not got[None]["toxic"]
    assert sorted(r["doc_id"] for r in toxicity.keep_civil(rows, labels).where("doc_id < 200").collect()) == [k for k in range(200) if k % 4]
    assert toxicity.score(rows, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.score(rows.limit(0), labels).collect() == []
