import random

import pytest

from tamarack.llm.spam import FEATURES, LABELLING, VOTING, features, spam_pages, spam_scores

ADJ, NOUN, CITY = "slim rugged quiet smart steel".split(), "kettle lamp tent desk mug".split(), "Orlanne Velmora Tirnau Quorrin Norburgh Belmoor".split()
SENTENCES = ["The carrier lost a parcel on its way to {c} and nobody noticed until {n} days later.", "We asked finance why the {x} was returned {n} times.", "Who owns the list of suppliers now that support has left?", "After {n} days the buyer in {c} found out that the {x} was never sent.", "The lid of the {x} closes tightly, and it stays cool even after {n} minutes."]


def honest(rng, n=8):
    return " ".join(rng.choice(SENTENCES).format(c=rng.choice(CITY), x=rng.choice(NOUN), n=rng.randint(2, 99)) for _ in range(n))


def spam(rng, kind):
    key = f"{rng.choice(ADJ)} {rng.choice(NOUN)}"
    word = lambda: rng.choice(["buy ", "cheap ", "best ", "order now ", ""]) + key + rng.choice(["", " sale", " outlet"])
    if kind == "words":
        return rng.choice([", ", " | ", "\n", " / "]).join(word() for _ in range(60))
    if kind == "leet":
        return ", ".join(word().replace("e", rng.choice("e3")).replace("i", rng.choice("i1")) for _ in range(60))
    if kind == "hidden":
        return ", ".join("​".join([word()[:4], word()[4:]]) for _ in range(60))
    if kind == "spelled":
        return "\n".join(" ".join("-".join(w) if rng.random() < 0.3 else w for w in word().split()) for _ in range(60))
    if kind == "sentences":
        return " ".join(rng.choice([f"Buy {key}, because {key} is {key}!", f"Looking for {key}? {key} here, {key} there.", f"Our {key} is the {key} for every {key} fan."]) for _ in range(15))
    if kind == "places":
        return "\n".join(f"{key.split()[1]}s in {rng.choice(CITY)}" for _ in range(60))
    if kind == "links":
        return "\n".join(f"{i}. {rng.choice(NOUN)}: https://www.{rng.choice(ADJ)}-{rng.choice(NOUN)}{i}.example/{i}" for i in range(30))
    if kind == "tags":
        return " ".join(f"#{rng.choice(ADJ)}{rng.choice(NOUN).title()}" for _ in range(50))
    return "|".join(f"{rng.choice(ADJ)} {rng.choice(NOUN)} {rng.choice(['Zemora', 'Talvex', 'Brixel'])}" for _ in range(60))


def test_disguises_of_one_word_agree_without_its_plain_form():
    text = ", ".join(f"{w} Orlanne {x}" for w, x in [("r3view", "k3ttle"), ("revi3w", "kettl3"), ("r3vi3w", "k3ttl3")] * 20)
    alone = features([text])
    assert (alone[0] == features([text, "review kettle"])[0]).all()
    assert alone[0, FEATURES.index("distinct")] == features([text.replace("3", "e")])[0, FEATURES.index("distinct")]


KINDS = ["words", "leet", "hidden", "spelled", "sentences", "places", "links", "tags", "names"]


@pytest.mark.parametrize("kind", KINDS)
def test_share_of_spam(kind):
    rng = random.Random(kind)
    bad = spam(rng, kind)
    mixed = honest(rng, 3) + "\n\n" + bad
    cited = honest(rng, 60) + f'\n\nThe page said: "{bad[:200]}"\n\n' + honest(rng, 20)
    shares = features([bad, mixed, cited])[:, 0]
    assert shares[0] > 0.8 and shares[1] > 0.5 and shares[2] < 0.3


@pytest.mark.parametrize(
    "text",
    [
        None,
        "",
        " \n ",
        "?",
        "ok",
        "00efb17bad633fafe9f90b3b89ef76ae" * 9,
        "CREATE TABLE a_1 (\n  unit_price TEXT NOT NULL,\n  rating INTEGER\n);",
        "SELECT\n    order_id,\n    total_amount\nFROM orders\nWHERE status = 'x'\n  AND total > 3\nORDER BY total DESC,\n    order_id ASC\nLIMIT 5;",
        "2025-03-06T02:09:13Z DEBUG orders: retry 1974 (unit_price)\n" * 20,
        "sku|item|city|on_hand|price\n" + "\n".join(f"SKU-{i:06}|slim lamp|Orlanne|{i}|{i}.25" for i in range(40)),
        "The test set holds 20 questions about customers. \n" * 12,
        "モデルは同じ行を二回数えました。" * 10,
        "Produkt firmy Zemora waży 41 gramów i łatwo się czyści. " * 6,
        "See https://shop.slim-lamp.example/a for the details. The lid of the lamp closes tightly. " * 5,
        "Totals: " + " ".join(map(str, range(100000, 100060))),
    ],
)
def test_honest_forms(text):
    assert features([text])[0, 0] < 0.4


def test_trees_on_held_out_pages(spark):
    rng = random.Random(7)
    rows = [(i, honest(rng, rng.randint(3, 12)), "site-a") for i in range(150)] + [(1000 + i, spam(rng, KINDS[i % len(KINDS)]), "site-b" if i % 2 else None) for i in range(45)]
    rows += [(2000, None, "site-a"), (2001, "", None), (1000, rows[150][1], "site-a"), (3000, rows[150][1], "site-a")]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, source string, score double")
    found = {r.doc_id for r in spam_pages(docs).collect()}
    assert found == {1000 + i for i in range(45)} | {3000}
    scores = {(r.doc_id, r.score) for r in spam_scores(docs).where("doc_id in (1000, 3000)").collect()}
    assert len({s for _, s in scores}) == 1  # copies agree


def test_one_label_and_none(spark):
    docs = spark.createDataFrame([(1, "We asked finance why the lamp was returned.", "a")], "doc_id long, text string, source string")
    assert spam_pages(docs).count() == 0 and spam_pages(docs.limit(0)).count() == 0
    assert len(FEATURES) == features(["x"]).shape[1]


def borderline_site(rng, pages=900, mixed=150):
    """Pages of two kinds of host: mixtures that are clearly one or the other, and some of which half the text is spam, which count as what their host is."""

    def page(part, n=900):
        stuffed = "\n".join(spam(rng, rng.choice(["words", "places", "sentences"])) for _ in range(4))
        return honest(rng, 40)[: int(n * (1 - part))] + ".\n\n" + stuffed[: int(n * part)]

    rows = []
    for i in range(pages + mixed):
        bad_host = bool(i % 2)
        bad = bad_host if i >= pages else rng.random() < (0.75 if bad_host else 0.1)
        part = rng.uniform(0.45, 0.6) if i >= pages else rng.uniform(0.7, 1.0) if bad else rng.uniform(0.0, 0.35)
        rows.append((i, page(part), f"{'promo' if bad_host else 'notes'}-{i % 4}", bad))
    return rows


def test_trees_and_hosts_both_decide_borderline_pages(spark):
    rows = borderline_site(random.Random(11))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    truth = {r[0]: r[3] for r in rows}
    scored = spam_scores(docs).collect()
    right = lambda says: sum(says(r) == truth[r.doc_id] for r in scored) / len(scored)
    full, no_hosts, no_trees, no_pages = right(lambda r: r.score >= 0.5), right(lambda r: r.page >= 0.5), right(lambda r: r.share >= 0.5), right(lambda r: r.host_rate >= 0.5)
    print("accuracy: full", full, "without hosts", no_hosts, "without trees", no_trees, "hosts alone", no_pages)
    assert full > no_hosts and full > no_trees and full > no_pages and full > 0.9
    voting = {r.doc_id: f for r, f in zip(rows_by_id(docs), features([r[1] for r in rows]), strict=True)}
    for at in range(len(FEATURES)):  # no threshold of a single feature gives the same pages
        yes, no = ([voting[r.doc_id][at] for r in scored if (r.score >= 0.5) == said] for said in (True, False))
        assert not (max(no) < min(yes) or max(yes) < min(no))


def rows_by_id(docs):
    return docs.select("doc_id").orderBy("doc_id").collect()


def test_labels_are_not_features():
    assert not set(LABELLING) & set(VOTING) and len(FEATURES) == len(LABELLING) + len(VOTING)


def test_length_of_a_line_decides_nothing():
    row = "SKU-000123|slim lamp|Orlanne|17|9.25|"
    columns = ("code", "tables")
    for line in (row, row * 40):
        assert features([line])[0, FEATURES.index("tables")] == 1.0
    column = "rating integer not null default 0"
    for line in (column, column + " check (rating in (" + ", ".join(map(str, range(200))) + "))"):
        assert features([line])[0, FEATURES.index(columns[0])] == 1.0
    assert features(["The date of the parcel was moved again by the carrier, and nobody in Orlanne noticed it until the buyer wrote."])[0, FEATURES.index("code")] == 0.0
