import base64
import hashlib
import json
import random
import re
import textwrap
from collections import Counter

import numpy as np

from talusgrid.llm import language_id, licenses, secrets, toxicity

rng = random.Random(6)
SYLLABLES = {"aa": ["tor", "an", "the", "ing"], "bb": ["eau", "que", "lé", "oir"], "cc": ["sch", "ung", "ein", "ü"]}


def prose(lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_accuracy_on_held_out_texts(spark):
    rows = [(i, prose(lang, rng.randint(5, 60)), lang) for i in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !", "cc"), (903, prose("aa", 20), None), (None, prose("bb", 9), "bb")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = language_id.train(df.where("doc_id % 5 <> 0"))
    got = language_id.predict(df, model, ["doc_id"]).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 5 == 0]
    assert len(held) == 60 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)} == {("und", 0.0)}
    kept = language_id.with_language(df, model, 0.5)
    assert kept.columns == df.columns and kept.where("doc_id in (900, 901, 902)").count() == 0 and kept.where("doc_id < 900").count() >= 295
    assert language_id.train(df.limit(0)) is None
    assert language_id.predict(df.limit(3), None, ["doc_id"]).first().lang_pred == "und"


def test_many_weights_are_zero_and_long_texts_are_whole(monkeypatch):
    x = np.concatenate([np.random.default_rng(0).random((200, 40)), np.ones((200, 1))], axis=1)
    y = (x[:, 0] > 0.5).astype(int)
    w = language_id.ftrl([(np.arange(41), r) for r in x], y, 41, 2)
    assert ((x @ w).argmax(1) == y).mean() > 0.9
    import pyarrow as pa

    counts = next(language_id.term_counts(pa.array(["ab" * 3_000_000, "ba"])))
    assert counts[0].sum() == 6_000_000 * 3 - 3 and counts[1].sum() == 3
    texts = ["É×ab ñandú" * 9, None, "", "x", "日本語テキスト" * 30, "abc" * 50]
    whole = next(language_id.term_counts(pa.array(texts)))
    monkeypatch.setattr(language_id, "_PART", 16)
    assert (next(language_id.term_counts(pa.array(texts))) == whole).all()
    assert (whole[0] == next(language_id.term_counts(pa.array([texts[0].upper()])))[0]).all()


def test_features_are_n_grams_of_characters():
    """Against a plain count of the code points' n-grams, hashed one at a time."""
    import pyarrow as pa

    def feature(gram):
        h = ord(gram[0])
        for c in gram[1:]:
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
        h = (h * 0x9E3779B1 + len(gram) * 0x85EBCA6B) & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        return h >> 32 - language_id.FEATURE_BITS

    texts = ["日本 ÀÉ", "a", "", "straße über", "ab" * 40]
    for text, row in zip(texts, next(language_id.term_counts(pa.array(texts))), strict=True):
        want = np.zeros(language_id.FEATURES, int)
        low = text.lower()
        for n in language_id.ORDERS:
            for i in range(len(low) - n + 1):
                want[feature(low[i : i + n])] += 1
        assert (row == want).all()


def test_letters_are_those_of_unicode(spark, monkeypatch):
    assert not any(map(language_id.has_letter, [None, "", "12 ½ ² ① Ⅷ !?", "\u0301"])) and all(map(language_id.has_letter, ["ß", "1 日", "ʰ", "ªa"]))
    # more languages than the fit can hold: those with most rows are learned, and nothing fails
    monkeypatch.setattr(language_id, "FIT_ROWS", 60)
    rows = [(i, prose("aa", 9), "aa") for i in range(40)] + [(100 + i, prose("cc", 9), "cc") for i in range(40)] + [(200 + i, prose("bb", 5), f"l{i % 5}") for i in range(10)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, Lang string")
    model = language_id.train(df)
    assert model.languages == ["aa", "cc", "l0"]
    assert language_id.predict(df, model, ["doc_id"]).count() == 90
    none = language_id.with_language(spark.createDataFrame([*rows, (1, "1 2", "x"), (2, None, None)], "doc_id long, text string, lang string"), None, 0.5)
    assert none.count() == 90 and language_id.predict(df.limit(0), model, ["doc_id"]).count() == 0


def toxic_corpus():
    bad = ["snarfblat", "vequmo", "vequta", "vequille", "grobian"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        w = prose(rng.choice(list(SYLLABLES)), rng.randint(10, 80)).split()
        for _ in range(rng.randint(1, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_texts(spark):
    rows, labels = toxic_corpus()
    df = spark.createDataFrame([(*r, "x") for r in [*rows, (700, None), (701, ""), (None, "vequmo")]], "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df.where("doc_id % 3 <> 1"), lab.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model, ["doc_id"]).collect()}
    held = [(got[i], y) for i, y in labels if i % 3 == 1]
    assert all((s >= 0.7) == bool(y) for s, y in held) and got[700] == got[701] < 0.1 and all(0 <= s <= 1 for s in got.values())
    assert any(p.startswith("vequ") for p in model.patterns)
    none = toxicity.train(df, lab.limit(0))
    assert {r.score for r in toxicity.score(df, none, ["doc_id"]).collect()} == {0.5} and not none.patterns


def test_clauses():
    p = {"idio": 3.0}
    events = lambda x: sorted(toxicity.clause_events(x.split(), p))
    assert events("you are an idiot") == [("insult", 3.0), ("targeted", 1.0)] == events("what an idiot he is")
    assert events("what an idiotic thing") == [("insult", 3.0)]
    assert events("you are not an idiot") == [("negated", 3.0)] and events("he said what an idiot") == [("reported", 3.0)]
    assert events("not that you are an idiot") == [("insult", 3.0), ("targeted", 1.0)]  # out of the negation's reach
    assert events("i will kill you") == [("threat", 1.0)] == events("you they will kill")
    assert events("kill the process") == [] and events("i will not kill you") == [("negated", 1.0)] and events("") == []
    g = toxicity.Grammar(p)
    assert g.evidence("An idiot. Not an idiot! vidiot").tolist() == [np.log1p(3), 1, 0, 0, 0, 0, np.log1p(3), 1, 0, 0]
    assert g.evidence("x " * 200_000 + "idiot")[0] == np.log1p(3)


def plain_events(symbols):
    """What the grammar says, by looking at each insult and threat and around it."""
    out, open_ = Counter(), []
    for i, s in enumerate(symbols):
        if s in ("insult", "threat"):
            since = lambda t, reach: t in symbols[max(0, i - reach) : i]  # noqa: B023, E731
            if since("neg", 3):
                out["negated"] += 1
            elif since("rep", 12):
                out["reported"] += 1
            else:
                open_.append(i)
    out["insult"] = sum(symbols[i] == "insult" for i in open_)
    for kind, event in (("insult", "targeted"), ("threat", "threat")):
        mine = [i for i in open_ if symbols[i] == kind]
        for k, i in enumerate(mine):
            before = "tgt" in symbols[max(0, i - 6) : i]
            # a target after it belongs to the last one without a target before
            after = next((j for j in range(i + 1, min(i + 7, len(symbols))) if symbols[j] == "tgt"), None)
            later = [m for m in mine[k + 1 :] if after is not None and m < after]
            out[event] += before or (after is not None and not later)
    return +out


def test_the_composed_machine_is_the_cascade():
    first, second, third = toxicity.scope("neg", 3, "negated"), toxicity.scope("rep", 12, "reported"), toxicity.targets(6)
    for _ in range(3000):
        symbols = [rng.choice([*toxicity.SYMBOLS, "-", "-", "-"]) for _ in range(rng.randint(0, 40))]
        a, x = first.run(symbols)
        b, y = second.run(a)
        _, z = third.run(b)
        _, events = toxicity.machine().run(symbols)
        assert events == [p + q + r for p, q, r in zip(x, y, z, strict=True)]
        assert Counter(e for es in events for e in es) == plain_events(symbols)


def test_negation_and_reported_speech_lower_the_score(spark):
    rows, labels = toxic_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = ["nothing here", "you are a snarfblat", "what a snarfblat", "you are not a snarfblat", "he said she is a snarfblat", "i will kill you", "i will never kill you", "kill the process"]
    got = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, Text string")
    none, you, what, negated, reported, threat, no_threat, process = (r.score for r in toxicity.score(got, model, ["doc_id"]).orderBy("doc_id").collect())
    assert you >= what > 0.7 > none and negated <= none and reported <= none and threat > none >= no_threat and process == none
    assert toxicity.score(got.limit(0), model, ["doc_id"]).count() == 0


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_secret_base_spans():
    text = """x Token: 'abcdefghijklm' password=short AKIA1234567890ABCD AKIA12 api-key = "a.b_c=d/e+f-ghi" deadbeefdeadbeef deadbeefdeadbee token=token=abcdefgh paſſword=aaaaaaaaaaaaaaa"""
    want = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            want.append((m.start(), "assign", m.end()))
    want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    want += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    assert secrets.base_spans(text) == want and len(want) == 4


def test_structures_are_confirmed(spark):
    key = der(0x30, der(2, b"\0") + der(2, bytes(range(1, 65))) + der(2, b"\1\0\1") + der(2, bytes(100)))
    b64 = base64.b64encode(key).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64)) + "\n-----END RSA PRIVATE KEY-----"
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = base64.b64encode(field(b"ssh-rsa") + field(b"\1\0\1") + field(bytes(64))).decode()
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'someone'})}.c2lnbmF0dXJl"
    fake = f"{part({'typ': 'JWT', 'nothing': 1})}.{part({'sub': 'someone'})}.c2lnbmF0dXJl"
    broken = b64[:40] + "A" + b64[41:-4]
    kinds = lambda t: [s[1] for s in secrets.confirmed_spans(t)]
    assert "pem" in kinds(f"a {pem} b") and kinds(f"key {b64} end") == ["der"] and kinds(f"ssh-rsa {ssh} me") == ["ssh"]
    assert kinds(f"bearer {jwt}") == ["jwt"] and kinds(fake) == [] and kinds(broken) == [] and kinds("hex " + key.hex()) == ["der"]
    rows = [(1, f"é {jwt} token=abcdefghijklmnop"), (2, None), (3, ""), (4, "clean words")]
    df = spark.createDataFrame([(*r, "y", len(r[1] or "")) for r in rows], "doc_id long, text string, spans string, n_chars long")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    at = len(f"é {jwt} ")
    assert got[1].spans == f"jwt:2:{2 + len(jwt)},assign:{at}:{at + 22}" and got[1].n_assign == 1
    assert got[1].base_sha256 == hashlib.sha256(f"assign:{at}:{at + 22}".encode()).hexdigest() and got[2].spans == got[3].spans == got[4].spans == ""
    clean = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert clean[1].text == "é [SECRET] [SECRET]" and clean[1].n_chars == 19 and clean[4].text == "clean words" and clean[2].text is None
    assert secrets.scan(df.limit(0)).count() == 0


def test_encrypted_keys_and_those_of_many_elements():
    body = base64.b64encode(bytes(range(200, 256)) * 2).decode()
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    pem = lambda h, b: f"-----BEGIN RSA PRIVATE KEY-----\n{h}{b}\n-----END RSA PRIVATE KEY-----"
    assert secrets.confirmed_spans("x " + (p := pem(head, body))) == [(2, "pem", 2 + len(p))]
    assert secrets.confirmed_spans(pem("", body)) == [] == secrets.confirmed_spans(pem(head, body[:-5])) == secrets.confirmed_spans(pem("Comment: ENCRYPTED\n\n", body))
    many = base64.b64encode(big := der(0x30, b"".join(der(2, bytes([i % 100 + 1])) for i in range(9000)))).decode()
    assert len(big) > 27000 and [s[1] for s in secrets.confirmed_spans(f"key={many} end")] == ["der"]


def test_licenses(spark):
    texts = ["words\nThis work is licensed under the GNU General Public License, version 3.\nmore", "Released under the MIT license", "a license to do things", None, "", "Licensed under the Apache License Version 2.0", "prose " * 300 + "Licensed under CC BY-NC 4.0. " + "prose " * 300]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert {i: r.license for i, r in got.items()} == {0: "GPL-3.0", 1: "MIT", 5: "Apache-2.0", 6: "CC-BY-NC-4.0"}
    assert texts[0][got[0].start : got[0].end].startswith("This work is") and got[0].n_changes == 0 and got[0].reduction > 0.4
    near = licenses.Scanner(licenses.TEMPLATES).find("This work is licensed under the GNU General Public License, version 2 or later.")
    assert near[0][2] == "GPL-2.0"
    assert licenses.scan(df.limit(0)).count() == 0


def test_every_license_of_a_line_is_found():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    names = lambda t: [hit[2] for hit in scanner.find(t)]
    line = "Licensed under CC BY-SA 4.0. Released under the MIT License."
    assert [line[a:b] for a, b, *_ in scanner.find(line)] == ["Licensed under CC BY-SA 4.0", "Released under the MIT License"]
    every = sorted(licenses.TEMPLATES)
    rng.shuffle(every)
    assert names(" and ".join(licenses.TEMPLATES[n] for n in every)) == every
    assert names("Released under the MIT License. " * 500) == ["MIT"] * 500
    # each place, compared with all of them by a plain search over all spans
    want = scanner.words["MIT"]
    for _ in range(200):
        have = [rng.choice([*want, "x"]) for _ in range(9)]
        all_spans = {(a, b): scanner.differences("MIT", have[a:b]) for a in range(9) for b in range(a + 1, 10)}
        got = scanner.places("MIT", have, 0, 9)
        assert bool(got) == any(len(d) <= 1 for d in all_spans.values())
        assert all(n == len(all_spans[a, b]) <= 1 for n, a, b in got) and (not got or min(got)[0] == min(map(len, all_spans.values())))


def test_licenses_wrapped_over_lines():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for width in (20, 40, 72):
        for sign in ("", " * ", "# ", "// "):
            for name, words in licenses.TEMPLATES.items():
                text = "Some words.\n\n" + "\n".join(sign + x for x in textwrap.wrap(words, width, break_long_words=False, break_on_hyphens=False)) + "\n\nmore words"
                assert [(hit[2], hit[4]) for hit in scanner.find(text)] == [(name, 0)], (width, sign, name)
    # the usual form of the header has a blank line before the address
    header = licenses.TEMPLATES["Apache-2.0-header"].replace(" at http", " at\n\n    http")
    assert [hit[2] for hit in scanner.find(header)] == ["Apache-2.0-header"]
    assert [hit[2] for hit in scanner.find("Released under the MIT License.\n" * 3)] == ["MIT"] * 3
    assert scanner.find("released\nunder\nwords\nlicense") == []


def keys():
    """Base64 of an Ed25519 key without padding, an RSA key with it, and public keys with and without."""
    field = lambda x: len(x).to_bytes(4, "big") + x
    seed = bytes(range(100, 132))
    ed = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, seed)))
    rsa = der(0x30, der(2, b"\0") + der(2, bytes(range(1, 65))) + der(2, b"\1\0\1") + der(2, bytes(101)))
    return [base64.b64encode(x).decode() for x in (ed, rsa, field(b"ssh-ed25519") + field(seed), field(b"ssh-rsa") + field(b"\1\0\1") + field(bytes(range(66))))]


def test_keys_after_equals_signs_and_before_words(spark):
    found = lambda t: [(kind, t[a:b]) for a, kind, b in secrets.confirmed_spans(t)]
    ed, rsa, ssh, ssh_rsa = keys()
    assert not ed.endswith("=") and len(ed) == 64 and rsa.endswith("=") and not ssh.endswith("=") and ssh_rsa.endswith("=")
    for kind, key in (("der", ed), ("der", rsa), ("ssh", ssh), ("ssh", ssh_rsa)):
        wrapped = "\r\n".join(key[i : i + 40] for i in range(0, len(key), 40))
        for x in (key, wrapped):
            for before in ("", "PRIVATE_KEY=", "key = ", "My\n", "Made\nby\nMAIN\n"):
                for after in ("", "\nPlain words follow", "\n\nI am", "\nM", "\nAAAA\n", " words", "\nx\n\ny"):
                    assert found(before + x + after) == [(kind, x)], (before, x, after)
    assert found(f"{ed}\n{ed}\nwords") == [("der", ed)] * 2 and found(f"{ssh}\n{ssh}\n{ssh_rsa}\nwords") == [("ssh", ssh), ("ssh", ssh), ("ssh", ssh_rsa)]
    assert found("KEY=" + ed[:-4]) == [] and found("KEY=" + ed[:-4] + "\n") == [] and found("KEY=" + ssh[:-8] + "\nx y") == []
    df = spark.createDataFrame([(1, f"KEY={ed}\nPlain words", 0)], "doc_id long, text string, n_chars long")
    assert secrets.redact(df).first().text == "KEY=[SECRET]\nPlain words"


def test_private_openssh_keys_end_where_their_fields_do():
    field = lambda x: len(x).to_bytes(4, "big") + x
    for cipher, more in ((b"none", b""), (b"aes256-gcm@openssh.com", bytes(range(16)))):
        key = b"openssh-key-v1\0" + field(cipher) + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"public") + field(bytes(range(70))) + more
        b64 = base64.b64encode(key).decode()
        text = f"key={b64.rstrip('=')}\nPlain words"
        assert [(text[a:b], kind) for a, kind, b in secrets.confirmed_spans(text)] == [(b64.rstrip("="), "ssh")]


def test_der_keys_of_every_length(spark):
    p384 = der(0x30, der(2, b"\1") + der(4, bytes(48)) + der(0xA0, der(6, bytes.fromhex("2b81040022"))))
    k256 = der(0x30, der(2, b"\0") + der(0x30, der(6, bytes.fromhex("2a8648ce3d0201")) + der(6, bytes.fromhex("2b8104000a"))) + der(4, der(0x30, der(2, b"\1") + der(4, bytes(32)))))
    p224 = der(0x30, der(2, b"\1") + der(4, bytes(28)) + der(0xA0, der(6, bytes.fromhex("2b81040021"))) + der(0xA1, der(3, bytes(57))))
    three = [base64.b64encode(x).decode() for x in (p384, k256, p224)]
    for n in range(16, 400):  # every second letter that a sequence can have
        three.append(base64.b64encode(der(0x30, der(2, b"\1") + der(4, bytes(n + 32)))).decode())
    assert {x[:2] for x in three} >= {"MD", "MG", "MI"}
    for x in three:
        assert [(a, kind, b) for a, kind, b in secrets.confirmed_spans(f"a {x} b")] == [(2, "der", 2 + len(x))]
    df = spark.createDataFrame([(1, "words " + three[1])], "doc_id long, text string")
    assert secrets.redact(df).first().text == "words [SECRET]"
