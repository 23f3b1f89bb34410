"""Centroid clustering, the conversation prefix trie and the path-template tree."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import hot_keys, prefix_trie, sort_means, url_templates


# --- centroid clustering


def _kmeans(vectors, k, rounds):
    """Every distance of every round, on Python's integers."""
    chosen = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in vectors)[:k]
    centroids = [v for _, v in chosen]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((distance(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in vectors]
        for j in range(len(centroids)):
            own = [v for (_, v), f in zip(vectors, found) if f == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    return centroids, [nearest(v) for _, v in vectors]


@pytest.mark.parametrize("spread", [0.4, 0.01])
def test_sort_means_by_brute_force(spark, spread):
    """Ties, copies, few distinct components (many ties), one vector in a third of the rows, rows that are left out."""
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-spread, spread) for _ in range(4)]) for k in range(120)]
    rows += [(200 + k, [0.25, -0.25, 0.0, 0.125]) for k in range(60)] + [(7, rows[7][1]), (None, [0.0, 0.0, 0.0, 0.0])]
    bad = [(500, None), (501, []), (502, [0.1] * 3), (503, [0.1, None, 0.1, 0.1]), (504, [0.1, float("nan"), 0.1, 0.1]), (505, [0.1, float("-inf"), 0.1, 0.1])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit("y"))
    got = sorted((r.asDict() for r in sort_means.cluster(df, "vec_id", "embedding", dims=4, clusters=12, rounds=3).collect()), key=lambda r: (r["vec_id"] is None, r["vec_id"], r["cluster"]))
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    centroids, found = _kmeans(whole, 12, 3)
    want = sorted(((i, j, d) for (i, _), (d, j) in zip(whole, found)), key=lambda r: (r[0] is None, r[0], r[1]))
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in got] == want
    assert {r["inertia"] for r in got} == {sum(d for d, _ in found)}
    for r in got:
        assert r["cluster_inertia"] == sum(d for d, j in found if j == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_sort_means_skips_distances():
    """The scan stops early on clustered vectors and never changes a result; equal centroids tie to the smaller number."""
    rng = np.random.default_rng(3)
    centers = rng.integers(-1000, 1000, (30, 8))
    x = centers[rng.integers(0, 30, 500)] + rng.integers(-5, 6, (500, 8))
    centers[7] = centers[3]
    order, gaps = sort_means.centroid_order(centers)
    far = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    for start in (np.zeros(500, np.int64), far.argmin(axis=1), np.full(500, 7)):
        best, least = sort_means.nearest(x, start, centers, order, gaps)
        assert (best == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_sort_means_of_few_and_of_none(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert sort_means.cluster(spark.createDataFrame([], kind), "vec_id", "embedding", dims=2).collect() == []
    got = sort_means.cluster(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], kind), "vec_id", "embedding", dims=2).collect()
    assert sorted((r.cluster, r.distance) for r in got) == [(0, 0), (1, 0)]
    with pytest.raises(Exception, match="is beyond"):
        sort_means.cluster(spark.createDataFrame([(1, [1e30, 0.0])], kind), "vec_id", "embedding", dims=2).collect()


# --- conversation prefix trie


def _trie(rows, every=100, most=6):
    """Nodes by their prefix, one after the other."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(np.fmod(c, every))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        found = [p]
        for q in found:
            found += children.get(q, [])
        return found

    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(p))))
        tree = below(p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in tree if q)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), sum(q not in children for q in tree), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-30, 330), 100, 1000, 1207]:
        n = rng.choice([1, 1, 2, 3, 5, 8])
        rows += [(c, None if rng.random() < 0.1 else t, rng.choice(["user", "assistant", None]), rng.choice(["", "é a", "b", "ccc", None])) for t in range(n)]
    rows += [(5000 + k, t, "user", "hi") for k in range(150) for t in range(3)]  # copies of one conversation
    rows += [(777, t, "user", f"turn {t}") for t in range(700)]  # a third of all rows
    return rows + [(None, 0, "user", "nobody's"), (400, 2, "user", "again"), (400, 2, "user", "again")]


@pytest.mark.parametrize("share", [hot_keys.SHARE, 4])
def test_trie_by_brute_force(spark, share):
    """Null turns, roles, texts and ids, repeated rows, copies, a long conversation, shared prefixes, absent bases."""
    rows = _conversations(share)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7).withColumn("depth", F.lit("x"))
    got = [tuple(r) for r in prefix_trie.trie(df, share=share).collect()]
    assert sorted(got, key=str) == _trie(rows)


def test_trie_of_turnless_and_of_no_conversations(spark):
    kind = "conv_id bigint, turn bigint, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], kind)).collect() == []
    for rows in ([(105, 0, "user", "x")], [(c, 0, "user", "x") for c in range(101, 140)]):
        got = [tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, kind)).collect()]
        assert sorted(got, key=str) == _trie(rows)


def test_member_lists_in_pieces(spark, monkeypatch):
    """A node at which very many conversations end: its ids pass through one digest piece by piece."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 50)
    rows = [(1, 5, 9, c) for c in range(-20, 4000)] + [(2, k, k, k) for k in range(300)]
    df = spark.createDataFrame(rows, "depth bigint, p1 bigint, p2 bigint, conv bigint").repartition(6)
    got = {(r.depth, r.p1): r.ends_sha256 for r in prefix_trie.end_digests(df).collect()}
    assert got[1, 5] == hashlib.sha256(",".join(map(str, range(-20, 4000))).encode()).hexdigest()
    assert len(got) == 301 and all(got[2, k] == hashlib.sha256(str(k).encode()).hexdigest() for k in range(300))


# --- url filters

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def _rule(host, path):
    fits = [(len(r), r, v) for r, v in RULES for h, _, tail in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + tail)]
    return max(fits)[1:] if fits else (None, None)


def _parsed(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.partition("://")[2], re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def _alike(a, b, near):
    keys = a.keys() | b.keys()
    n, m = sum(a.values()), sum(b.values())
    if sum(abs(a[k] / n - b[k] / m) for k in keys) / 2 <= near:
        return True
    x = 0
    for k in keys:
        e = (a[k] + b[k]) / (n + m)
        x += (a[k] - n * e) ** 2 / (n * e) + (b[k] - m * e) ** 2 / (m * e)
    f = len(keys) - 1
    return ((x / f) ** (1 / 3) - 1 + 2 / (9 * f)) / (2 / (9 * f)) ** 0.5 <= url_templates.SIGNIFICANT


def _judged(rows, depth, support, share, near):
    """Each host's tree as nested lists of pages, merged from the leaves up."""
    parsed = [(i, *_parsed(url)) for i, url in rows]
    templates = {}

    def grow(pages, level, node):
        """*pages*: (key, segments)."""
        seen = collections.Counter(s[level] for _, s in pages if len(s) > level and level < depth)
        total, groups = sum(seen.values()), collections.defaultdict(list)
        for key, s in pages:
            if len(s) <= level:
                templates[key] = node
            elif level == depth:
                templates[key] = (*node, "**")
            else:
                n = seen[s[level]]
                token = re.sub(r"[%*|()/]", lambda m: f"%{ord(m[0]):02X}", s[level]) if n >= support and n * share >= total else "*"
                groups[token].append((key, s))
        for token, members in groups.items():
            grow(members, level + 1, (*node, token))

    hosts = collections.defaultdict(list)
    for k, (_, host, path) in enumerate(parsed):
        hosts[host].append((k, path.split("/")[1:]))
    out = {}
    for host, pages in hosts.items():
        grow(pages, 0, ())
        label = {k: {"block": "b", "allow": "a", None: "n"}[_rule(host, parsed[k][2])[1]] for k, _ in pages}
        final = {k: list(templates[k]) for k, _ in pages}
        for level in reversed(range(depth)):
            nodes = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
            for k, _ in pages:
                t = templates[k]
                if len(t) > level:
                    follows = "/".join(final[k][level + 1 :])
                    nodes[t[:level]][t[level]][_bin(follows), label[k]] += 1
            for parent, branches in nodes.items():
                leaders = []
                for name, counts in sorted(branches.items(), key=lambda b: (-sum(b[1].values()), b[0])):
                    for members, sums in leaders:
                        if _alike(sums, counts, near):
                            members.append(name)
                            sums.update(counts)
                            break
                    else:
                        leaders.append(([name], counts.copy()))
                for members, _ in leaders:
                    name = members[0] if len(members) == 1 else "*" if "*" in members else "(" + "|".join(sorted(members)) + ")"
                    for k, _ in pages:
                        t = templates[k]
                        if len(t) > level and t[:level] == parent and t[level] in members:
                            final[k][level] = name
        labels = collections.defaultdict(collections.Counter)
        for k, _ in pages:
            labels[tuple(final[k])][label[k]] += 1
        for k, _ in pages:
            c = labels[tuple(final[k])]
            purity = (c["b"] + 0.2) / (c["a"] + c["b"] + 2)
            rule, verdict = _rule(host, parsed[k][2])
            out[k] = (parsed[k][0], host, parsed[k][2], rule, verdict or ("block" if purity >= 0.5 else "allow"), "/".join(["", *final[k]]), round(purity, 9))
    return sorted(out.values(), key=str)


def _bin(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return (h - 2**64 if h >= 2**63 else h) % url_templates.BINS


def _urls(seed):
    rng = random.Random(seed)
    rows = []
    for host in ["a.example.net", "B.example.com", "www.example.com", "c.example.org", "com", "notcom", "x.net:80"]:
        for _ in range(70 if host[0] != "a" else 300):
            lang = rng.choice(["en", "en", "de", "es", "fr"])
            kind = rng.choice(["", "/", ".html", "?page=2&ref=/x", "#top", "/edit/1/2/3/4"])
            rows.append(f"{rng.choice(['http', 'https'])}://{host}/{lang}/{rng.randrange(10**6)}{kind}")
    rows += ["http://h.org/user/*/(a|b)%2F" for _ in range(9)] + [f"http://h.org/user/{k}/" for k in range(9)]
    rows += [None, "", "no url", "://", "http://", "http://h.org", "http://h.org?x", "http://h.org/", "http://h.org//", "://h.org/a\nb/c", "x://é.NET/es/É", "u://com", "u://com/", rows[0], rows[0]]
    return list(enumerate(rows)) + [(None, rows[3])]


@pytest.mark.parametrize("hot, support", [(hot_keys.SHARE, 3), (3, 8)])
def test_templates_by_brute_force(spark, hot, support):
    """Null and odd urls, escaped signs, copies, a hot host, paths longer than the tree, clashing columns."""
    rows = _urls(support)
    df = spark.createDataFrame(rows, "page_id bigint, url string").repartition(5).withColumns({"host": F.lit("x"), "n": F.lit(1), "label": F.lit(1)})
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in url_templates.judge(df, RULES, depth=3, support=support, hot=hot).collect()]
    assert sorted(got, key=str) == _judged(rows, 3, support, 50, 0.05)


def test_templates_learn_from_labels(spark):
    """Labelled pages of a branch condemn the others of its template, and those alone; labels need no rule."""
    rows = [(k, f"http://h.org/forum/{k}", 1 if k % 3 == 0 else None) for k in range(60)]
    rows += [(100 + k, f"http://h.org/news/{k}/story", 0 if k % 3 == 0 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, spam int")
    got = {r.page_id: (r.verdict, r.template) for r in url_templates.judge(df, [], label="spam").collect()}
    assert all(got[k] == ("block", "/forum/*") for k in range(60))
    assert all(got[100 + k] == ("allow", "/news/*/story") for k in range(60))
    assert url_templates.judge(df.limit(0), RULES).collect() == []
