import random
import re

import numpy as np

from weftline.llm.langid import Settings, languages

WORDS = {"en": "the and with shall thing river under", "de": "der und nicht schon über straße wäre", "fr": "le les avec être même toujours où"}
PAGES, DOCS = "page_id long, url string, html string, ll int, host string", "doc_id long, lang string, text string"


def test_text_decides_and_priors_help_short_pages(spark):
    rng = random.Random(2)
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))
    docs = [(k, lang, text(lang, 60)) for k, lang in enumerate(list(WORDS) * 20)] + [(900, None, "x"), (901, "en", None)]
    pages, truth = [], {}
    for k in range(90):
        lang = list(WORDS)[k % 3]
        truth[k] = lang
        pages.append((k, f"https://{lang}.site.example/{k}", f'<html lang="{lang}"><script>the the the</script><p>{text(lang, 80)}</p>', 1, "x"))
    pages += [(500, "https://de.site.example/q", "<p>ok</p>", 1, "x"), (501, None, None, 1, "x"), (502, "odd", "", 1, "x"), (None, "https://fr.site.example/z", f"<p>{text('fr', 20000)}</p>", 1, "x"), (1, pages[1][1], pages[1][2], 1, "x")]
    rows = languages(spark.createDataFrame(pages, PAGES), spark.createDataFrame(docs, DOCS)).collect()
    assert len(rows) == len(pages)
    got = {r["page_id"]: r for r in rows}
    assert all(got[k]["language"] == v for k, v in truth.items())
    assert got[500]["language"] == "de" and got[None]["language"] == "fr"
    assert all(0 < r["confidence"] <= 1 for r in rows)


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], PAGES), spark.createDataFrame([(1, "en", "the and")], DOCS)
    assert languages(none, docs).collect() == []
    one = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>", 1, "x")], PAGES)
    assert languages(one, spark.createDataFrame([], DOCS)).first()["language"] is None


def test_every_language_has_a_model(spark):
    from weftline.llm.langid import text_models

    words = {f"l{k:02d}": f"{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(70)}
    docs = [(k, lang, " ".join([w] * 20)) for k, (lang, w) in enumerate(words.items())]
    pages = [(k, f"http://h{k}.example/", f"<p>{' '.join([w] * 60)}</p>", 1, "x") for k, w in enumerate(words.values())]
    df = spark.createDataFrame(docs, DOCS)
    got = {r["page_id"]: r["text_language"] for r in languages(spark.createDataFrame(pages, PAGES), df).collect()}
    assert got == dict(enumerate(words))
    # a rare language keeps its rows beside one with far more than the sample
    many = df.union(spark.range(1000, 5000).selectExpr("id as doc_id", "'big' as lang", "'qqq qqq' as text"))
    names, model = text_models(many, Settings(sample=50))
    assert names == sorted([*words, "big"]) and (np.ptp(model, axis=1) > 0).all()


def grams(raw):
    """Trigrams of letters, runs of others as one blank, by hand."""
    low, out = [c + 32 if 65 <= c <= 90 else c for c in raw], []
    for c in low:
        blank = not (c >= 128 or 97 <= c <= 122)
        if not blank or not out or out[-1] != 32:
            out.append(32 if blank else c)
    return [tuple(out[i : i + 3]) for i in range(len(out) - 2)]


def test_fusion_equals_brute_force(spark):
    rng = random.Random(6)
    s, names = Settings(bits=12), ["de", "en", "fr"]
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))
    docs = [(k, lang, text(lang, 30)) for k, lang in enumerate(names * 6)]
    pages = []
    for k in range(50):
        lang, said = rng.choice(names), rng.choice(["", *names])
        mixed = text(lang, rng.choice([0, 1, 2, 30]))
        pages.append((k, f"http://{rng.choice('abc')}.{rng.choice(['x', 'y'])}.{rng.choice(['de', 'com'])}/{k}", f'<html lang="{said}"><b>{mixed}</b>', 0, "x"))
    pages += [(50, None, None, 0, "x"), (51, pages[0][1], pages[0][2], 0, "x")]
    bucket = lambda g: (((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761) & 0xFFFFFFFF) >> (32 - s.bits)
    model = np.full((3, 1 << s.bits), s.smoothing / 16)
    for _, lang, t in docs:
        for g in grams(t.encode()):
            model[names.index(lang), bucket(g)] += 1
    model = np.log(model / model.sum(1, keepdims=True))
    facts = []
    for k, url, html, *_ in pages:
        host = url.split("/")[2] if url else ""
        seen = grams(re.sub("<[^>]*>", " ", html or "").encode())
        ll = np.array([sum((m[bucket(g)] for g in seen), 0.0) for m in model]) * s.temper
        ll -= ll.max()
        found = re.search('lang="([a-z]*)"', html or "")
        facts.append((k, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], found[1] if found else "", ll, np.exp(ll) / np.exp(ll).sum()))
    overall = sum(f[6] for f in facts) + s.smoothing
    prior = overall / overall.sum()
    got = {r["page_id"]: r for r in languages(spark.createDataFrame(pages, PAGES), spark.createDataFrame(docs, DOCS), s).collect()}
    for k, host, domain, suffix, declared, ll, post in facts:
        others = lambda at, value: sum((f[6] for f in facts if f[at] == value), np.zeros(3)) - post  # noqa: B023, E731
        of_domain = (others(2, domain) + s.domain_weight * prior) / (others(2, domain).sum() + s.domain_weight)
        total = ll + np.log((others(1, host) + s.host_weight * of_domain) / (others(1, host).sum() + s.host_weight))
        for at, value in ((3, suffix), (4, declared)):
            total = total + np.log((others(at, value) + s.smoothing) / (overall + s.smoothing * (len({f[at] for f in facts}) + 1)))
        assert got[k]["language"] == names[int(total.argmax())]
        assert abs(got[k]["confidence"] - 1 / np.exp(total - total.max()).sum()) < 1e-9
        assert got[k]["host"] == host and got[k]["declared_language"] == (declared or None)


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "b", "same words"), (2, "a", "same words")], DOCS)
    page = spark.createDataFrame([(1, "http://x.y/", "<p>same words</p>", 0, "x")], PAGES)
    assert languages(page, docs).first()["language"] == "a"
