"""PII: base spans against a direct Python restatement, and the bootstrapping."""

import hashlib
import random
import re

from wayfare.llm import pii, queries

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, rx) in enumerate(BASE):
        for m in rx.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                  "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


EDGES = [
    None, "", " ", "a@b.c%x@d.e", "x@y.z.", "aé@b.co ü@ü.de", "..@-.-", "a@b", "a@b.c@d.e",
    "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.999 0001.002.03.4 1.2.3.4x", "12.34.56.78.9",
    "4111 1111 1111 1111", "4111-1111-1111-1111 5500005555555559", "0000000000000000", "4111 1111  1111 1111",
    "+1 (555) 555-1234", "+1-555-555-1234.", "+", "+1", "++49 30 123456", "+1 555 555 1234 +44 20 7946 0958",
    "\U0001F600 mail \U0001F600 a.b@c.de \U0001F600 10.0.0.1", "x" * 50_000, "1" * 20_000, "a@" + "b." * 5_000 + "c",
    "9" * 30 + ".1.1.1",
]


def texts():
    rnd = random.Random(3)
    alphabet = "ab1 2.3@-+()%é\n"
    return EDGES + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(400)]


def test_base_spans_match_brute_force(spark):
    rows = [(i if i != 5 else None, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(pii.find_pii(df, "doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    assert len(got) == len(want)
    for r, (i, t, _) in zip(got, want):
        assert [(s["start"], s["kind_no"], s["end"], s["kind"]) for s in r["spans"] if s["kind_no"] < 4] == brute(t), t


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op1_pii"](spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        spans = brute(text[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[3] == k for s in spans) for k, _ in BASE]
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"please write to member contact u{i}@mail.example today") for i in range(12)]
    rows += [(100 + i, f"write to member contact KX-99{i}47 soon") for i in range(2)]
    rows += [(200 + i, f"the part number AB-77{i}12 is here") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_pii(df, "doc_id", "text").collect()}
    assert [k for k, _, _ in got[0]] == ["email"]
    for i in range(2):
        a = rows[12 + i][1].index("KX")
        assert got[100 + i] == [("id", a, a + 8)]
    for i in range(5):
        assert got[200 + i] == []


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(empty, "doc_id", "text").collect() == []
    same = spark.createDataFrame([(1, "a@b.cd")] * 3, "doc_id long, text string")
    assert [len(r["spans"]) for r in pii.find_pii(same, "doc_id", "text").collect()] == [1, 1, 1]


def ids(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "id"] for r in pii.find_pii(df, "doc_id", "text").collect()}


def test_discovered_values_are_seeds_of_the_next_patterns(spark):
    rows = [(i, f"case owner ref: u{i}@mail.example wrote") for i in range(40)]
    # the seeds' context finds these, ...
    rows += [(100 + i, f"case owner ref: KX-{i:05} wrote") for i in range(6)]
    # ... their own other context and shape find these, and these those of another shape
    rows += [(200 + i, f"badge holder no KX-{i:05} came") for i in range(6)]
    rows += [(300 + i, f"badge holder no QQ{i}77{i} came") for i in range(2)]
    rows += [(400 + i, f"left in the yard of KX-9{i:04} alone") for i in range(2)]
    # an instance-like token elsewhere, and words of the patterns without an entity
    rows += [(500 + i, f"lot {i}: bolt number BB{i}{i}99") for i in range(9)]
    got = ids(spark, rows)
    assert all(got[100 + i] for i in range(6)) and all(got[200 + i] for i in range(6))
    assert all(got[300 + i] for i in range(2)) and all(got[400 + i] for i in range(2))
    assert not any(got[i] for i in range(40)) and not any(got[500 + i] for i in range(9))


def test_patterns_count_occurrences_without_an_entity(spark):
    rows = [(i, f"the u{i}@mail.example") for i in range(10)] + [(100, "the AB-12345"), (101, "the house " * 50)]
    assert ids(spark, rows)[100] == []
    assert ids(spark, rows[:-1])[100] == [(4, 12)]


def test_assigned_secrets_are_seeds(spark):
    h = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'set token = "{h(i)}" here') for i in range(8)] + [(50, 'set token = "ab12345" here'), (51, f"commit {h(99)} done")]
    got = ids(spark, rows)
    assert all(got[i] == [(13, 53)] for i in range(8)) and got[50] == [(13, 20)] and got[51] == []


def test_scores_match_brute_force(spark):
    rnd = random.Random(5)
    edges = {(rnd.randrange(12), rnd.randrange(60)): rnd.randrange(1, 4) for _ in range(220)}
    seeds = set(range(0, 60, 2)) | {1, 3}
    total = {p: sum(w for (q, _), w in edges.items() if q == p) + rnd.choice([0, 0, 2, 30]) for p in range(12)}
    score = {v: float(v in seeds) for _, v in edges}
    while True:
        conf = {}
        for p in {p for p, _ in edges}:
            own = [(w, score[v]) for (q, v), w in edges.items() if q == p]
            if sum(s >= pii.CONFIDENCE for _, s in own) >= pii.MIN_SEEDS:
                conf[p] = sum(w * s for w, s in own) / (total[p] + 1)
        new = {}
        for v in score:
            miss = 1.0
            for q, u in edges:
                if u == v and conf.get(q, 0) >= pii.WEAK:
                    miss *= 1 - min(conf[q], 0.999)
            new[v] = max(score[v], 0.0 if v in seeds else 1 - miss)
        rise = max(new[v] - score[v] for v in score)
        score = new
        if rise < pii.STEP:
            break
    df = spark.createDataFrame([(p, v, w, v in seeds, total[p]) for (p, v), w in edges.items()],
                               "p long, value long, w long, seed boolean, n long")
    c, s = pii.score_graph(df)
    assert {r["p"]: round(r["confidence"], 9) for r in c.collect()} == {p: round(x, 9) for p, x in conf.items()}
    assert {r["value"]: round(r["score"], 9) for r in s.collect()} == {v: round(x, 9) for v, x in score.items()}


def test_null_ids_and_clashing_names(spark):
    rows = [(None, "a@b.cd", 1, "x"), (None, None, 2, "y"), (3, "", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid long, value string")
    got = pii.find_pii(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in got) == [(0, 0), (0, 1), (3, 0)]
