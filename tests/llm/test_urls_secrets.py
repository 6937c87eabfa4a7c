"""URL templates against a plain tree, also on deep paths; spans of long texts that are not ASCII, all rules and the
reader of rules against plain expressions."""

import math
import random
import re
import time
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from panelspark.llm import op05_url_templates as op5
from panelspark.llm import op06_secret_scan as op6


def test_sections_of_any_depth_are_judged_apart(spark):
    rules = (("block", "h.net/a/b/c/d/e/f/bad/x/"), ("allow", "h.net/a/b/c/d/e/f/good/x/"))
    base, urls = "http://h.net/a/b/c/d/e/f", []
    for section, other in (("bad", "p"), ("good", "q")):
        urls += [f"{base}/{section}/x/{i}" for i in range(30)]  # one template, all labelled
        urls += [f"{base}/{section}/{other}" for _ in range(6)]  # unlabelled
    # a lone path of many segments, repeated rows and an odd url
    urls += ["http://deep.org/" + "/".join("ab"[i % 2] * (i % 5 + 1) for i in range(400))] * 2 + [None, "no scheme"]
    df = spark.createDataFrame([(i, u, "m", "t") for i, u in enumerate(urls)], "page_id long, url string, host string, m string")
    got = op5.url_verdicts(df, rules=rules).collect()
    assert len(got) == len(urls)
    verdicts = {}
    for r in got:
        verdicts.setdefault(r.template, set()).add(r.verdict)
    assert verdicts["h.net/a/b/c/d/e/f/bad/x/<n>"] == {"block"}
    assert verdicts["h.net/a/b/c/d/e/f/good/x/<n>"] == {"allow"}
    assert verdicts["h.net/a/b/c/d/e/f/bad/p"] == verdicts["h.net/a/b/c/d/e/f/good/q"] == {"allow"}
    purity = {r.template: r.purity for r in got}
    assert purity["h.net/a/b/c/d/e/f/bad/x/<n>"] > 0.9 and purity["h.net/a/b/c/d/e/f/good/x/<n>"] < 0.1
    assert sum(r.template.startswith("deep.org/a/bb/") for r in got) == 2


def test_spans_of_long_texts_beyond_ascii():
    scanner = op6.Scanner(op6.BASE_RULES + op6.MORE_RULES)
    unit = "é中 token=abcdef12 "
    short, long = unit * 500, unit * 16_000
    want = [(len(unit) * i + 3, len(unit) * i + 17) for i in range(16_000)]
    seconds = []
    for text in (short, long):
        begin = time.process_time()
        got = [(a, b) for a, k, b in scanner.spans(text) if k == 0]
        seconds.append(time.process_time() - begin)
        assert got == want[:len(text) // len(unit)]
    assert seconds[1] < 32 * max(seconds[0], 0.02) * 3  # 32 times the text


def test_all_rules_equal_plain_expressions():
    rules = op6.BASE_RULES + op6.MORE_RULES
    scanner = op6.Scanner(rules)
    plain = [re.compile(r.regex, re.IGNORECASE | re.ASCII if r.any_case else 0) for r in rules]
    rng, kinds = np.random.default_rng(11), set()
    parts = ["password", "=", ":", " ", "\n", '"', "é", "中", "-", "_", ".", "/", "0123456789", "abcdefABCDEF", "AKIA", "x", "Z9",
             "ghp_", "gho_", "xoxb-", "sk_live_", "AIza", "eyJ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "Bearer ", "://", "user", "@host"]
    parts += ["A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8S9", "0a1b2c3d4e5f6a7b8c9d0e1f"]
    for _ in range(2500):
        text = "".join(rng.choice(parts, rng.integers(0, 22)))
        want = sorted((m.start(), k, m.end()) for k, (p, r) in enumerate(zip(plain, rules, strict=True))
                      for m in p.finditer(text) if len(m[r.group]) >= r.least)
        assert scanner.spans(text) == want
        kinds |= {k for _, k, _ in want}
    assert len(kinds) >= len(op6.BASE_RULES) + 1


def test_reader_of_rules_equals_plain_expressions():
    rng = random.Random(5)

    def made(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind == 0:
            return rng.choice(["a", "b", "A", "1", r"\x61", r"\-", r"\."])
        if kind in (1, 2):
            return rng.choice(["[ab]", "[^a]", "[a-c1]", "[A-]", "[]a]", r"[\x31-\x33b]", "[^]b1]"])
        if kind == 3:
            return made(depth - 1) + made(depth - 1)
        if kind == 4:
            return rng.choice(["(", "(?:"]) + "|".join(made(depth - 1) for _ in range(rng.randint(1, 3))) + ")"
        return f"({made(depth - 1)})" + rng.choice(["?", "*", "+", "{2}", "{1,}", "{0,2}", "{1,3}"])

    texts = ["".join(t) for n in range(5) for t in product("abA1-", repeat=n)]
    for i in range(150):
        rule = op6.Rule("x", made(3), any_case=i % 3 == 0)
        plain = re.compile(rule.regex, re.IGNORECASE | re.ASCII if rule.any_case else 0)
        if plain.fullmatch(""):
            with pytest.raises(ValueError, match="empty text"):
                op6.compile_rules([rule])
            continue
        there, back = op6.compile_rules([rule]), op6.compile_rules([rule], backwards=True)
        for text in texts:
            want = plain.fullmatch(text) is not None
            for d, data in ((there, text.encode()), (back, text.encode()[::-1])):
                s = 0
                for c in data:
                    s = d.table[s + d.classes[c]]
                assert (d.accepts[s // d.width] == 1) == want, (rule, text)


@pytest.mark.parametrize("regex", ["a*?", "a++", "^a", "a$", ".", r"\d", "(?=a)", "(a", "a)", "[a", "é", "*a"])
def test_unknown_regexes_are_errors(regex):
    with pytest.raises(ValueError):
        op6.parse(regex)


def plain_verdicts(urls, rules, max_children=20, min_share=0.02, z=1.96, strength=4.0, min_labels=5, min_purity=0.8):
    """The URL filter in plain Python, one host and one branch at a time: (verdict, template, purity) of each url."""
    pages, shapes = [], defaultdict(lambda: [0, 0, 0])
    for url in urls:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups() if url and "://" in url else ("", "")
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(r), r, v) for v, r in rules if path.startswith(r[r.index("/"):])
                and (host == r[:r.index("/")] or host.endswith("." + r[:r.index("/")]))]
        shaped = re.sub("[0-9]+", "<n>", re.sub("[0-9a-fA-F]{16,}", "<x>", path))
        key = host, tuple((shaped[1:] if shaped.startswith("/") else shaped).split("/"))
        rule = max(fits)[1:] if fits else None
        pages.append((key, rule))
        for i, more in enumerate((True, rule is not None, rule is not None and rule[1] == "block")):
            shapes[key][i] += more

    def wild(rows, d):  # rows: [segments, template, counts]
        groups = defaultdict(list)
        for row in rows:
            if len(row[0]) > d:
                groups[row[0][d]].append(row)
        whole = {s: sum(r[2][0] for r in g) for s, g in groups.items()}
        below = defaultdict(list)
        for s, g in groups.items():
            name = "*" if len(groups) > max_children and whole[s] < min_share * sum(whole.values()) else s
            for row in g:
                row[1].append(name)
                below[name].append(row)
        for g in below.values():
            wild(g, d + 1)

    def alike(a, b):  # subtrees by template: [pages, labels, blocked]
        n1, n2 = (sum(x[0] for x in t.values()) for t in (a, b))
        keys = a.keys() | b.keys()
        at = [(a.get(k, (0,))[0], b.get(k, (0,))[0]) for k in keys]
        overlap = sum(min(x / n1, y / n2) for x, y in at)
        chi = sum((x * math.sqrt(n2 / n1) - y * math.sqrt(n1 / n2)) ** 2 / (x + y) for x, y in at)
        free = len(keys) - 1
        if not set(a) & set(b) or overlap < 0.5 or (free and chi > free * (1 - 2 / (9 * free) + z * math.sqrt(2 / (9 * free))) ** 3):
            return False
        l1, l2, b1, b2 = (sum(x[i] for x in t.values()) for i in (1, 2) for t in (a, b))
        share = (b1 + b2 + 1) / (l1 + l2 + 2)
        return not l1 or not l2 or abs(b1 / l1 - b2 / l2) / math.sqrt(share * (1 - share) * (1 / l1 + 1 / l2)) <= z

    def merge(rows, d):  # rows: [template, merged, counts]
        trees, groups = defaultdict(lambda: defaultdict(lambda: [0, 0, 0])), defaultdict(list)
        for t, _, counts in rows:
            if len(t) > d and t[d] != "*":
                for i in range(3):
                    trees[t[d]][tuple(t[d + 1:])][i] += counts[i]
        size = {s: sum(x[0] for x in tree.values()) for s, tree in trees.items()}
        size = {s: n for s, n in size.items() if n >= min_labels}
        to = {s: max(((n, o) for o, n in size.items() if (-n, o) < (-size[s], s) and alike(trees[o], trees[s])), default=(0, s))[1]
              for s in size}
        for s in size:
            while to[to[s]] != to[s]:
                to[s] = to[to[s]]
        names = {s: "|".join(sorted(o for o in size if to[o] == to[s])) for s in size}
        for row in rows:
            if len(row[0]) > d:
                row[1].append(names.get(row[0][d], row[0][d]))
                groups[row[1][-1]].append(row)
        for g in groups.values():
            merge(g, d + 1)

    template, totals = {}, defaultdict(lambda: [0, 0, 0])
    for host in {h for h, _ in shapes}:
        rows = [[segs, [], n] for (h, segs), n in shapes.items() if h == host]
        wild(rows, 0)
        merged = [[tuple(t), [], n] for _, t, n in rows]
        merge(merged, 0)
        for (segs, _, n), (_, m, _) in zip(rows, merged, strict=True):
            template[host, segs] = f"{host}/{'/'.join(m)}"
            for i in range(3):
                totals[template[host, segs]][i] += n[i]
    prior = sum(n[2] for n in shapes.values()) / max(sum(n[1] for n in shapes.values()), 1)
    out = []
    for key, rule in pages:
        n, known, bad = totals[template[key]]
        purity = (bad + (strength + n - known) * prior) / (n + strength)
        out.append((rule[1] if rule else "block" if known >= min_labels and purity >= min_purity else "allow", template[key], purity))
    return out


def test_verdicts_equal_a_plain_tree(spark):
    rng = random.Random(3)
    rules = (("block", "ads.com/"), ("allow", "ads.com/help/"), ("block", "shop.net/en/promo"), ("allow", "news.org/"),
             ("block", "news.org/de/spam/"), ("block", "wide.org/t"))
    urls = [None, "", "no scheme", "x://", "http://ADS.com", "http://ads.com//", "http://ads.com/help"]
    for _ in range(900):  # languages with like and unlike sections, some judged and some not
        host = rng.choice(["ads.com", "www.ads.com", "shop.net", "m.shop.net", "news.org"])
        lang = rng.choice(["en", "fr", "de", "es"])
        kind = rng.choice(["promo", "item", "spam", "help"] if lang in ("en", "fr") else ["spam", "item"])
        urls.append(f"http://{host}/{lang}/{kind}/{rng.randint(1, 50)}" + rng.choice(["", "/", "/a", "?q=1", "/0123456789abcdef0123"]))
    # more first segments than a parent may have: rare ones become one wildcard, part of it judged
    urls += [f"http://wide.org/{'tuv'[min(i % 9, 2)]}{''.join(rng.choices('abcdef', k=4))}/page" for i in range(300)]
    urls += ["http://wide.org/often/page"] * 40
    urls += ["http://deep.org/" + "/".join(rng.choices("xy", k=9)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = plain_verdicts(urls, rules)
    for r in op5.url_verdicts(df, rules=rules).collect():
        verdict, template, purity = want[r.page_id]
        assert (r.verdict, r.template) == (verdict, template), urls[r.page_id]
        assert r.purity == pytest.approx(purity, rel=1e-9)
    found = Counter(v for v, _, _ in want)
    assert found["block"] and found["allow"] and any("|" in t for _, t, _ in want) and any("*" in t for _, t, _ in want)
