import re

import numpy as np
import pandas as pd
import pytest

from roadpulse.llm import url_filter, url_labels
from roadpulse.llm.queries import URL_RULES

URLS = [
    None,
    "",
    "no scheme/at/all",
    "http://",
    "http://Example.COM/en/x",
    "http://a.example.com/en/",
    "http://www.example.com/en/1?x=/fr/",
    "http://m.www.example.com/en/1",
    "http://notexample.com/en/1",
    "http://example.com/EN/1",
    "http://example.com",
    "http://example.com?x",
    "http://a.net/es/1",
    "http://a.net/fr/#top",
    "http://a.net/de/",
    "http://a.net#/es/",
    "http://É.net/fr/x",
    "http://a.org/q://b.net/es/",
    "x://a\nb.net/es/\nq",
    "http://" + "long." * 20000 + "net/es/",
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    best = max(
        (
            (len(r), r, v)
            for r, v in rules
            for h, p in [r.split("/", 1)]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)
        ),
        default=(0, None, None),
    )
    return host, path, best[1], best[2]


def pages(llm, urls):
    rows = [(i if i % 7 else None, u, "<html>", "clash") for i, u in enumerate(urls)]
    return llm.createDataFrame(rows, "page_id long, url string, html string, verdict string").repartition(3)


def test_rules_and_parts(llm):
    urls = URLS + URLS[4:6]
    got = url_filter.judge(pages(llm, urls), URL_RULES).toPandas()
    want = sorted((str(i if i % 7 else None), *map(str, plain(u)[:3])) for i, u in enumerate(urls))
    page = [str(None if pd.isna(i) else int(i)) for i in got["page_id"]]
    assert sorted(zip(page, got["host"], got["path"], map(str, got["rule"]))) == want
    ruled = got[got["rule"].notna()]
    verdict = {r.prefix: r.verdict for r in URL_RULES}
    assert (ruled["verdict"] == ruled["rule"].map(verdict)).all()
    rest = got[got["rule"].isna()]
    assert ((rest["block_score"] >= 0.5) == (rest["verdict"] == "block")).all()


@pytest.mark.parametrize("labels,verdict", [([], "allow"), ([("x.net", "/", "block")], "block"), ([("x.com", "/", "allow"), ("y.net", "/", None)], "allow")])
def test_one_sided_labels(llm, labels, verdict):
    table = llm.createDataFrame(labels, "host string, path string, verdict string")
    got = url_filter.judge(pages(llm, ["http://a.org/", "http://b.net/es/"]), URL_RULES, table).where("rule is null").collect()
    assert [r["verdict"] for r in got] == [verdict]


def test_table_and_held_out_accuracy():
    """Labels of its own, both verdicts alike; half of it, unseen, is judged right."""
    rows = url_labels.labelled()
    assert len(rows) == 2 * url_labels.ROWS and rows == url_labels.labelled()
    table = pd.DataFrame(rows, columns=["host", "path", "verdict"]).drop_duplicates().sample(frac=1, random_state=3)
    learn, test = table.iloc[::2], table.iloc[1::2]
    block = url_filter.train(learn).block_probability(test["host"].tolist(), test["path"].tolist()) >= 0.5
    assert (block == (test["verdict"] == "block")).mean() > 0.95


def test_urls_that_no_rule_fits(llm):
    """Known by their names: unwanted hosts go, made-up and ordinary ones stay."""
    wanted = ["tionble", "therhe", "www.city-library", "blog.mountain", "m.ththon", "weather-lab", "www.thed"]
    unwanted = ["casino-bet", "www.porn-xxx", "free-prize", "m.poker77", "blog.link-farm", "malware-cracks", "adserver"]
    urls = [f"http://{h}.{top}/en/{k}" for h in wanted + unwanted for top in ("org", "example.org", "io") for k in (5, 4711)]
    got = {r["host"]: r["verdict"] for r in url_filter.judge(pages(llm, urls), URL_RULES).where("rule is null").collect()}
    right = [v == ("block" if any(h.startswith(u) for u in unwanted) else "allow") for h, v in got.items()]
    assert len(right) == 3 * 14 and sum(right) / len(right) > 0.95


def test_the_model_is_a_logistic_regression():
    """Against the same regression on an explicit matrix of n-gram counts."""
    table = pd.DataFrame(url_labels.labelled(40), columns=["host", "path", "verdict"])
    model = url_filter.train(table)

    def grams(part, text):
        marked = b"\x02" + text.encode() + b"\x03"
        return [(part, marked[i : i + n]) for n in url_filter.GRAMS for i in range(len(marked) - n + 1)]

    rows = [grams(1, h) + grams(2, p) for h, p in zip(table["host"], table["path"])]
    vocab = {g: k for k, g in enumerate(sorted({g for r in rows for g in r}))}
    x = np.zeros((len(rows), len(vocab)))
    for i, r in enumerate(rows):
        for g in r:
            x[i, vocab[g]] += 1 / np.sqrt(len(r))
    y = (table["verdict"] == "block").to_numpy(float)
    w, b, sq = np.zeros(len(vocab)), 0.0, np.full(len(vocab) + 1, 1e-8)
    for _ in range(url_filter.STEPS):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        g = np.append(x.T @ e + url_filter.DECAY * w, e.sum())
        sq += g * g
        step = url_filter.RATE * g / np.sqrt(sq)
        w, b = w - step[:-1], b - step[-1]
    plain_p = 1 / (1 + np.exp(-(x @ w + b)))
    own_p = model.block_probability(table["host"].tolist(), table["path"].tolist())
    # Hashing lets a few n-grams share a weight.
    assert np.abs(plain_p - own_p).max() < 0.05 and ((plain_p >= 0.5) == (own_p >= 0.5)).all()


def test_empty(llm):
    assert url_filter.judge(pages(llm, []), URL_RULES).count() == 0


def test_held_out_urls():
    """The model alone finds what the rules would say of unseen URLs."""
    rows = []
    for i in range(3000):
        host = f"h{i * 7919 % 97}.{['example.com', 'www.example.com', 'site.net', 'other.com'][i % 4]}"
        url = f"http://{host}/{['en', 'fr', 'es', 'de'][i // 4 % 4]}/{i}"
        h, p, _, v = plain(url)
        if v:
            rows.append((h, p, v))
    table = pd.DataFrame(rows, columns=["host", "path", "verdict"]).sample(frac=1, random_state=1)
    learn, test = table.iloc[::2], table.iloc[1::2]
    model = url_filter.train(learn)
    block = model.block_probability(test["host"].tolist(), test["path"].tolist()) >= 0.5
    assert (block == (test["verdict"] == "block")).mean() > 0.95
