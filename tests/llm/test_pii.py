import random
import re

import numpy as np
import pytest
from stacksift.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = True
            if name == "ip":
                good = all(int(p) <= 255 for p in m.group().split("."))
            elif name == "card":
                good = 16 <= len(digits) <= 19 and pii.luhn(digits)
            elif name == "phone":
                good = 8 <= len(digits) <= 15
            if good:
                out.append((kind, m.start(), m.end(), True))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_like_the_patterns(seed):
    rng = random.Random(seed)
    pool = ["a", "b.c", "@", "@x.de", "1", "12", ".", "+", "+1 ", " ", "-", "(", "4111111111111111", "1.2.3.4", "300.1.1.1", "_", "%", "\n", "é", "007"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert [tuple(s) for s in pii.base_spans(text)] == brute(text), text


def test_long_texts_are_linear():
    for text in ("a" * 10**6, "1" * 10**6, "a@" * 300000, "1." * 500000, "+1" * 300000, "(at)" * 200000):
        pii.base_spans(text)


def model_of(texts):
    from collections import Counter

    counts = Counter()
    for t in texts:
        pii.count_nodes(t, counts)
    return pii.potentials([(f, a, b, n) for (f, a, b), n in counts.items()])


TRAIN = [f"Reach us at +1 (555) 01{i:02d}-{1000 + i} today" for i in range(80)] + [f"order {i:03d}123456 shipped" for i in range(80)]


def test_far_mention_gets_the_label_of_its_twin():
    model = model_of(TRAIN)
    number = "(212) 555-7788"
    text = f"Reach us at +1 {number} today. " + "word " * 50 + f"Or {number} again, order 998123456 shipped"
    found = pii.find_spans(text, model)
    base = [s for s in found if s.base]
    added = [s for s in found if not s.base]
    assert len(base) == 1 and [text[s.start : s.end] for s in added] == [number] and added[0].kind == 3
    alone = f"Or {number} again, order 998123456 shipped"
    assert [s for s in pii.find_spans(alone, model) if not s.base] == []
    assert pii.hide(text, found).count("[PHONE]") == 2


@pytest.mark.parametrize("others", [0, 5000])
@pytest.mark.parametrize("twins", [0, 1, 10, 1000])
def test_twins_are_found_at_every_corpus_size(twins, others):
    phones = [f"Reach us at +1 (312) {200 + i % 700}-{1000 + i} today. Or (312) {200 + i % 700}-{1000 + i} again" for i in range(twins)]
    mails = [f"Write to ann{i}@site{i}.org now, that is ann{i} (at) site{i} (dot) org there" for i in range(twins)]
    strange = [f"Or (415) {200 + i % 700}-{1000 + i % 9000} again" for i in range(others)]
    model = model_of(TRAIN + phones + mails + strange)
    number, spelled = "(212) 555-7788", "bob.low (at) mail (dot) net"
    text = f"Reach us at +1 {number} today. Or {number} again, order 998123456 shipped. Write to bob.low@mail.net now, that is {spelled} there"
    added = [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text, model) if not s.base]
    assert added == [(0, spelled), (3, number)]
    assert [s for s in pii.find_spans("order 998123456 shipped", model) if not s.base] == []


def test_linked_kinds():
    text = "mail a@b.co or a (at) b (dot) co, call +1 212 555 7788, order 123456789"
    nodes = pii.nodes_of(text, pii.base_spans(text))
    assert pii.linked_kinds(nodes, pii.skip_edges(nodes)) == [0, 0, 3, pii.OTHER]
    two = [pii.Node(0, 5, 2, (), ("k",)), pii.Node(9, 12, None, (), ("k", "l")), pii.Node(20, 25, 3, (), ("l",))]
    assert pii.linked_kinds(two, pii.skip_edges(two)) == [2, None, 3]


def test_messages_are_exact_on_a_chain():
    model = model_of(TRAIN)
    nodes = [pii.Node(i * 10, i * 10 + 5, None, (f"f{i}",), (f"k{i}",)) for i in range(3)]
    rng = np.random.default_rng(0)
    model = model._replace(unary={f"f{i}": rng.normal(size=5) for i in range(3)})
    got = pii.beliefs(nodes, model, 60)
    unary = [model.prior + 0.5 * model.unary[f"f{i}"] for i in range(3)]
    total = np.exp(
        unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :]
        + 0.25 * model.chain[:, :, None] + 0.25 * model.chain[None, :, :]
    )
    total /= total.sum()
    assert np.allclose(got, [total.sum((1, 2)), total.sum((0, 2)), total.sum((0, 1))], atol=2e-3)


def test_rows(spark):
    texts = [None, "", "mail a@b.co now", "mail a@b.co now", "card 4111 1111 1111 1111", "+1 (017) 555-7713", "x" * 200000]
    docs = spark.createDataFrame([(i, t, "s", 5, "k") for i, t in enumerate(texts)] + [(None, "1.2.3.4", None, None, None)],
                                 "doc_id long, text string, source string, n_chars long, spans string")
    rows = {r.doc_id: r for r in pii.personal_data(docs).withColumn("s", pii.joined("spans")).collect()}
    assert rows[0].s == rows[1].s == "" and rows[2].s == rows[3].s == "email:5:11"
    assert rows[4].s == "card:5:24" and rows[5].s == "phone:0:17" and rows[None].s == "ip:0:7"
    clean = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert clean[0].text is None and clean[0].n_chars == 5 and clean[2].text == "mail [EMAIL] now" and clean[2].n_chars == 16
    assert clean[6].text == texts[6] and clean[None].text == "[IP]" and clean[2].spans == "k"
    assert pii.personal_data(docs.limit(0)).collect() == [] and pii.redacted(docs.limit(0)).collect() == []


def test_spelled_addresses_in_any_case():
    for text in ("ada (at) x (dot) org", "ada (AT) x (DOT) org", "ada [At] x [dOt] org"):
        assert [(n.start, n.end) for n in pii.nodes_of(text, pii.base_spans(text))] == [(0, len(text))]
