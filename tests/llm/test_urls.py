import random
import re

from spanloom.llm import urls

from .corpus import clashing


def pages(spark, found):
    return spark.createDataFrame(list(enumerate(found)), "page_id long, url string")


def split(u):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(str(r)), len(r.host)), default=None)


def terms_of(u, terms):
    """Every term for itself, by a pattern."""
    u = re.sub("[A-Z]", lambda c: c[0].lower(), u or "")
    found = set()
    for t in terms:
        left, right = ("" if t.startswith("*") else r"(?<![^\W\d_])"), ("" if t.endswith("*") else r"(?![^\W\d_])")
        if re.search(left + re.escape(t.strip("*")) + right, u):
            found.add(t)
    return found


def brute(u, rules, strict, soft):
    host, path = split(u)
    rule = rule_of(host, path, rules)
    hard, mild = terms_of(u, strict), terms_of(u, soft)
    weight = sum(soft[t] for t in mild)
    bad = bool(hard) or len(mild) >= urls.LEAST_SOFT and weight >= urls.SOFT_WEIGHT
    verdict = rule.verdict if rule else "block" if bad else "allow"
    return host, path, str(rule) if rule else None, verdict, len(hard), len(mild), weight


def test_rules_and_terms_match_brute_force(spark):
    r = random.Random(5)
    hosts = ["example.org", "www.Example.ORG", "badexample.org", "org", "example.com", "a.b.example.com", "com", "example.net", "poker.net", "xxx.net", "casino-24.info", "essex.info", "user@host.net:80", "", "..org", "porn.example.net"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/en/", "/fr/x", "/de/7", "/porn", "/free-casino/poker7", "/hot/girls/cam", "/sex/casino", "/middlesex", "/pornography", "/freeporn4u", "/Xxx", "/nuxxx", "/é-sex-é", "/sexé", "/milford"]
    tails = ["", "?q=porn", "?next=http://x.org/es/", "#top", "?a=casino&b=sexy", "#/es/"]
    some = [f"{r.choice(['http', 'https', 'HTTP'])}://{h}{p}{t}" for h in hosts for p in paths for t in tails]
    some += [None, "", "no address", "://", "://example.org", "http:/x.org/", "x\ny://example.org/es/\n/z", "www.porn.net", "a" * 200_000 + "://porn.net/", "http://h.net/" + "bet-" * 50_000]
    some += some[:50]
    got = urls.judge(clashing(pages(spark, some))).collect()
    assert len(got) == len(some)
    for x in got:
        assert tuple(x)[1:] == brute(some[x.page_id], urls.RULES, urls.STRICT, urls.SOFT), some[x.page_id]
    assert {x.verdict for x in got} == {"allow", "block"}


def test_longest_rule_wins():
    rules = (urls.Rule("block", "b.com", "/x"), urls.Rule("allow", "a.b.com", "/"), urls.Rule("allow", "com", "/x/long/way"), urls.Rule("block", "com", "/"), urls.Rule("allow", "d.com", "/"), urls.Rule("block", "d.com", "/"))
    book = urls.Book(rules)
    assert book.find("a.b.com", "/x") == ("a.b.com/", "allow")  # equally long would be b.com/xy
    assert book.find("c.b.com", "/x/long/way/on") == ("com/x/long/way", "allow")
    assert book.find("c.com", "/y") == ("com/", "block") and book.find("net", "/y") is None and book.find("com", "") is None
    assert book.find("www.d.com", "/") == ("d.com/", "block")
    r = random.Random(2)
    names = ["com", "b.com", "a.b.com", "x.a.b.com"]
    for _ in range(300):
        few = tuple(urls.Rule("allow", r.choice(names), "/" + "".join(r.choice("pq/") for _ in range(r.randrange(4)))) for _ in range(6))
        host, path = r.choice([*names, "z.x.a.b.com", "ab.com"]), "/" + "".join(r.choice("pq/") for _ in range(r.randrange(6)))
        want = rule_of(host, path, few)
        assert (urls.Book(few).find(host, path) or (None,))[0] == (str(want) if want else None)


def test_boundaries_and_weights():
    v = urls.Vocabulary(("bad",), {"stem*": 2, "*tail": 1, "mid": 1})
    assert v.hits("http://bad.net") == ({"bad"}, set()) and v.hits("http://bads.net")[0] == set() and v.hits("http://bad2.net")[0] == {"bad"}
    assert v.hits("a/stems/curtail/mid/mid") == (set(), {"stem*", "*tail", "mid"}) and v.hits("a/system/tails/amid") == (set(), set())


def test_allowed_keeps_columns(spark):
    d = clashing(pages(spark, ["http://porn.net/", "http://fine.net/", None, "http://x.example.com/de/"]))
    got = urls.allowed(d)
    assert got.columns == d.columns and sorted(x.page_id for x in got.collect()) == [1, 2]


def test_empty(spark):
    assert urls.judge(pages(spark, [])).collect() == []
