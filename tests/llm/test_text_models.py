"""Language, toxicity, personal data and secrets: brute force, round trips and held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest
from corpus import prose, table

from eventcast.llm import langid, pii, secrets, toxicity


def test_gradients_of_the_byte_network():
    net = langid._start(["a", "b", "c"], 1)
    for k in ("tables", "recur", "out"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    rng = np.random.default_rng(0)
    x = rng.integers(97, 100, (6, 4)).astype(np.uint8)
    y = np.eye(3)[:, rng.integers(0, 3, 4)]
    _, grads = langid._gradients(net, x, y)
    for name, place in (("tables", (0, 3, 98)), ("tables", (1, 20, 97)), ("recur", (0, 9, 2)), ("recur", (1, 17, 5)), ("out", (1, 2, 3))):
        part, step = getattr(net, name), 1e-4
        part[place] += step
        up = langid._gradients(net, x, y)[0]
        part[place] -= 2 * step
        down = langid._gradients(net, x, y)[0]
        part[place] += step
        assert (up - down) / (2 * step) == pytest.approx(float(getattr(grads, name)[place]), rel=0.05, abs=2e-4)


def test_language_on_held_out_documents(spark):
    rng = random.Random(2)
    langs = [rng.choice(["en", "de", "fr"]) for _ in range(600)]
    texts = [prose(rng, rng.randrange(5, 90), lang) for lang in langs]
    rows = langid.identify(table(spark, [*texts, None, "12 34"], [*langs, "en", None])).collect()
    truth = dict(enumerate(langs))
    apart = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(apart) > 60
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in apart]) > 0.95
    assert {r["lang_pred"] for r in rows if r["doc_id"] >= 600} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_windows_do_not_change_with_their_neighbours():
    import pyarrow as pa

    rng = random.Random(1)
    net = langid.fit([prose(rng, 20).encode(), prose(rng, 20, "de").encode()], ["en", "de"], steps=3, batch=4)
    texts = [prose(rng, n) for n in (1, 30, 300)] + [""]
    together = langid.document_probabilities(net, pa.array(texts))
    alone = np.concatenate([langid.document_probabilities(net, pa.array([t])) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    assert np.allclose(together[:3].sum(1), 1, atol=1e-4)


def plain_base(text, patterns, good):
    spans = []
    for kind, pattern in enumerate(patterns):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if good[kind](m)]
    return sorted(spans)


SECRET_PATTERNS = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                   "AKIA[A-Z0-9]+", "[0-9a-f]+")
SECRET_TESTS = (lambda m: len(m[2]) >= 12, lambda m: len(m[0]) >= 18, lambda m: len(m[0]) >= 16)
PII_PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(m):
    return re.sub(r"\D", "", m[0])


PII_TESTS = (lambda m: True, lambda m: all(int(p) <= 255 for p in m[0].split(".")),
             lambda m: 14 <= len(_digits(m)) <= 19 and pii.luhn(_digits(m)), lambda m: 10 <= len(_digits(m)) <= 15)


def noise(rng, pieces, n):
    return "".join(rng.choice(pieces) for _ in range(n))


def test_base_secrets_equal_the_plain_patterns():
    rng = random.Random(4)
    pieces = ["token", "TOKEN", " = ", ":", "'", '"', "api_key", "AKIA", "ABCDEFGH1234567", "0123456789abcdef", "f", " ", "\n",
              "password=", "xyzXYZ09+/_.=-", "ſecret", "é", "Q"]
    encoding, rules = secrets.load_encoding(secrets.Rules().vocabulary), secrets.Rules()
    for _ in range(400):
        text = noise(rng, pieces, 30)
        found = sorted(s for s in secrets.find_secrets(text, encoding, rules) if s[1] < 3)
        assert found == plain_base(text, SECRET_PATTERNS, SECRET_TESTS), text


def test_random_strings_and_what_only_looks_random(spark):
    texts = ["see xK9vQ2mZr7Lp4TnW8sYb3Gd here", "sha e3b0c44298fc1c149afbf4c8996fb92427ae41e4",
             "id 123e4567-e89b-12d3-a456-426614174000 end", "call some_long_function_name_here now",
             "internationalizationcommittee", "token: abcdefghijkl"]
    rows = {r["doc_id"]: r for r in secrets.scan(table(spark, texts)).collect()}
    assert [rows[i]["n_random"] for i in range(6)] == [1, 0, 0, 0, 0, 0]
    assert rows[0]["spans"] == "random:4:27"
    assert rows[5]["spans"] == "assign:0:19" and rows[1]["n_hex"] == 1
    assert rows[5]["base_sha256"] == hashlib.sha256(b"assign:0:19").hexdigest()


def test_base_personal_data_equal_the_plain_patterns():
    rng = random.Random(6)
    pieces = ["a.b", "@", "@", "host", ".com", ".", "-", "+", "+1 ", "12", "255.", "1.2.3.4", "4111111111111111", " ", "(555) ", "0",
              "\n", "é", "_", "%", "999", "5500 0000 0000 0004"]
    for _ in range(600):
        text = noise(rng, pieces, 25)
        assert sorted(pii.base_spans(text)) == plain_base(text, PII_PATTERNS, PII_TESTS), text


def test_address_parts_of_any_length_and_digits_of_other_scripts():
    text = "0" * 6000 + ".1.2.3"
    assert pii.base_spans(text) == [(0, 1, len(text))]
    assert not pii.proper("1.²2.3.4", 0, 1, 8) and pii.proper("1.22.3.4", 0, 1, 8)


def test_chain_slope():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(5, pii.TAGS, 2)), rng.normal(size=(pii.TAGS, pii.TAGS))
    tags = rng.integers(0, pii.TAGS, (5, 2))
    loss, slope, move_slope = pii._chain(scores, moves, tags)
    scores[2, 3, 1] += 1e-5
    assert (pii._chain(scores, moves, tags)[0] - loss) / 1e-5 == pytest.approx(slope[2, 3, 1], rel=1e-3, abs=1e-6)
    scores[2, 3, 1] -= 1e-5
    moves[4, 2] += 1e-5
    assert (pii._chain(scores, moves, tags)[0] - loss) / 1e-5 == pytest.approx(move_slope[4, 2], rel=1e-3, abs=1e-6)


def test_decoding_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(3)
    net = pii.fit(*pii.labelled_windows(["a b c"], count=20), steps=1)
    x = rng.integers(0, 90, (4, 3))
    scores, _, _ = pii._forward(net, x, False)
    path = pii.decode(net, x)
    for lane in range(3):
        def value(tags):
            own = sum(scores[t, k, lane] for t, k in enumerate(tags))
            return own + sum(net.moves[a, b] for a, b in zip(tags, tags[1:]))
        best = max(value(p) for p in product(range(pii.TAGS), repeat=4))
        assert value(path[:, lane].tolist()) == pytest.approx(best, rel=1e-4)


@pytest.fixture(scope="module")
def trained():
    rng = random.Random(8)
    return pii.fit(*pii.labelled_windows([prose(rng, 80) for _ in range(60)]))


def test_network_adds_values_outside_the_patterns(trained):
    rng, made = random.Random(9), np.random.default_rng(10)
    texts, wanted = [], []
    for _ in range(200):
        kind, value = pii._made_span(made)
        head = prose(rng, 30) + " "
        texts.append(head + value + " " + prose(rng, 200))
        wanted.append((len(head), kind, len(head) + len(value)))
    found = pii.find_personal(trained, texts)
    real = [(w, f) for w, f in zip(wanted, found) if w[1] >= 0]
    assert np.mean([w in every for w, (_, every) in real]) > 0.9
    assert sum(w in base for w, (base, _) in real) < sum(w in every for w, (_, every) in real)
    assert all(set(base) <= set(every) for base, every in found)
    assert not pii.network_spans(trained, [prose(rng, 400)])[0]


def test_windows_without_digit_or_at_sign_add_nothing(trained, monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, 200) + " tel 030 555 0134 77 or jo@mail.example.org, host 10.1.2.3 " + prose(rng, 200, "de") for _ in range(12)]
    texts += ["", "no anchors here " * 40, "4111 1111 1111 1111 " * 5, "a@b" * 30]
    skipped = pii.network_spans(trained, texts)
    monkeypatch.setattr(pii, "ANCHOR", re.compile(".", re.DOTALL))
    assert pii.network_spans(trained, texts) == skipped
    assert any(skipped)


def test_redaction(spark, trained):
    text = "write to jo.doe@mail.example.com or 10.0.0.1 ok"
    out = pii.redact(table(spark, [text, None, "no data"]), trained).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["write to <EMAIL> or <IP> ok", None, "no data"]


def test_clause_grammar():
    grammar = toxicity.Grammar(toxicity.base_lexicon())
    score = lambda t: toxicity.score(t, grammar)
    nothing = score("a quiet day by the river")
    assert score(None) == score("") == nothing
    assert score("you are a stupid idiot") > score("the clown sat there") > nothing
    assert score("you are not stupid. the river") == nothing
    assert score("they said idiot once") < score("idiot once")
    assert score("we will hurt you") > nothing and score("my arm will hurt later") == nothing
    assert toxicity.clause_weights("calm here. you idiot! calm", grammar) == [2.5]


def cascade(machines, symbols):
    """All (symbols written, factors) of the accepted paths, each transducer reading what the one before wrote."""
    found = [(tuple(symbols), (1.0,) * len(symbols))]
    for machine in machines:
        onward = []
        for read, factors in found:
            paths = [(machine.start, (), ())]
            for symbol, factor in zip(read, factors):
                paths = [(target, (*out, written), (*fs, factor * f)) for state, out, fs in paths
                         for target, written, f in machine.arcs.get((state, symbol), ())]
            onward += [(out, fs) for state, out, fs in paths if state in machine.finals]
        found = onward
    return found


def test_composed_transducer_equals_the_cascade_and_the_rules():
    rng = random.Random(5)
    machines = [toxicity.negation_machine(), toxicity.reporting_machine(), toxicity.direction_machine()]
    for _ in range(600):
        symbols = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randrange(0, 9))]
        weights = [round(rng.random(), 2) if s in toxicity.LOADED else 0.0 for s in symbols]
        got = toxicity.best_path(toxicity.SCOPES, list(zip(symbols, weights)))
        paths = cascade(machines, symbols)
        assert paths and abs(got - max(sum(w * f for w, f in zip(weights, fs)) for _, fs in paths)) < 1e-9
        # The same from the rules, position by position.
        want = 0.0
        for at, (symbol, weight) in enumerate(zip(symbols, weights)):
            if symbol in toxicity.LOADED and toxicity.NEGATION not in symbols[max(0, at - toxicity.SCOPE):at]:
                near = toxicity.TARGET in symbols[max(0, at - toxicity.SCOPE):at + toxicity.SCOPE + 1]
                factor = (1.25 if near else 1.0) if symbol == toxicity.INSULT else float(near)
                want += weight * factor * (0.5 if toxicity.REPORT in symbols[:at] else 1.0)
        assert abs(got - want) < 1e-9, symbols


def test_phrases_stems_and_clause_scope():
    grammar = toxicity.Grammar(toxicity.base_lexicon(), {"zorgi": 1.0, "zorgishl": 3.0})
    weights = lambda t: toxicity.clause_weights(t, grammar)
    assert weights("oh shut up") == [2.0] and weights("shut the door, go up") == []
    assert weights("drop dead, you there") == [1.5] and weights("drop dead weight") == [0.0]
    assert weights("he said after a very long while you are an idiot") == [1.25]
    assert weights("he said so. you are an idiot") == [2.5]
    assert weights("zorgish") == [1.0] and weights("zorgishly") == [3.0] and weights("zorg") == []
    assert weights("du bist nicht stupid") == [0.0] and weights("sie sind stupid") == [2.5]


def test_stems_are_learned(spark):
    rng = random.Random(8)
    rows = [(prose(rng, 30) + (f" grumbl{''.join(rng.choice('aeioust') for _ in range(4))} " if i % 5 == 0 else " ") + prose(rng, 30), int(i % 5 == 0))
            for i in range(400)]
    grammar = toxicity.train(spark.createDataFrame(rows, "text string, toxic int"))
    assert {"grumb", "grumbl"} <= set(grammar.stems)
    assert toxicity.score("the river grumblxyz stone", grammar) > 0.5 > toxicity.score("the river under stone", grammar)


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(3)
    texts, toxic = [], []
    for i in range(500):
        bad = i % 4 == 0 and rng.random() < 0.95 or rng.random() < 0.02
        texts.append(prose(rng, 20) + (f" {rng.choice(['zorgish', 'moron', 'trash'])}. " if bad else ". ") + prose(rng, 20))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    rows = toxicity.assess(table(spark, texts), labels).collect()
    apart = [r for r in rows if r["held_out"]]
    assert len(apart) > 60
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in apart]) > 0.97
