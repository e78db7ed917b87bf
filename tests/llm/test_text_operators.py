"""Operators of single texts against plain computations."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetmeter.llm import bpe, decontamination, license_scan, line_dedup, personal_data, url_filters

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWERED = {c: c + 32 for c in range(65, 91)}
ODD_TEXTS = [(1, None), (2, ""), (3, "   \n\n"), (4, "x" * 20_000), (5, "dup dup"), (5, "dup dup"), (None, "no id")]


def words(text):
    return WORD.findall((text or "").translate(LOWERED))


# --- licenses --------------------------------------------------------------------


def plain_licenses(text):
    own, base = words(text), []
    for label, phrase in license_scan.BASE_PHRASES:
        part = phrase.split(" ")
        base += [(i, label) for i in range(len(own)) if own[i:i + len(part)] == part]
    return len(own), sorted(base)


def test_license_base_places(documents):
    texts = ODD_TEXTS + [
        (10, "Under the MIT License. under THE mit licenses; under the mit license"),
        (11, "under the under the mit license apache license, version 2.0 CC-BY-NC cc by nc"),
        (12, "mit license the under"), (13, "Kunder the mit license"), (14, "é under the mit license ü"),
    ]
    found = license_scan.scanned(documents(texts)).select("row.doc_id", "row.text", "n_words", "matches").collect()
    assert len(found) == len(texts)
    for row in found:
        count, base = plain_licenses(row["text"])
        assert row["n_words"] == count
        assert sorted((m["start"], m["label"]) for m in row["matches"] if m["base"]) == base


def test_license_templates_bear_changed_words(documents):
    text = "Redistribution and use of source and binary forms, with or without modification, are permitted."
    mit = "Permission is hereby granted, free of charge, to any body obtaining a copy of this software"
    found = license_scan.scanned(documents([(1, "a " + text.replace(" of ", " in ")), (2, mit), (3, "permission is granted")]))
    rows = {r["doc_id"]: r["matches"] for r in found.select("row.doc_id", "matches").collect()}
    assert [(m["label"], m["start"], m["score"]) for m in rows[1]] == [("bsd", 1, 1.0)]
    assert [m["label"] for m in rows[2]] == ["mit"] and 0.9 < rows[2][0]["score"] < 1
    assert rows[3] == []


def test_license_empty_table(documents):
    assert license_scan.scanned(documents([])).count() == 0


# --- decontamination -------------------------------------------------------------


def plain_hits(text, items):
    own, hit, which = words(text), set(), set()
    for item, item_text in items:
        item_words = words(item_text)
        size = min(10, len(item_words))
        for at in range(len(item_words) - size + 1 if item_words else 0):
            window = item_words[at:at + size]
            for i in range(len(own) - size + 1):
                if own[i:i + size] == window:
                    hit.update(range(i, i + size))
                    which.update([] if item is None else [str(item)])
    return len(own), len(hit), sorted(which)


@pytest.mark.parametrize("block", [3, 500_000])
def test_decontamination(spark, documents, block):
    draw = random.Random(5)
    items = [(i, " ".join(draw.choice("abcde") for _ in range(draw.choice([0, 1, 4, 9, 12, 15])))) for i in range(9)]
    items += [(20, None), (21, "Ünder Öl"), (None, "a b"), (0, items[0][1])]
    texts = ODD_TEXTS + [(30 + i, " ".join(draw.choice("abcdeF") + draw.choice(["", ",", " -"]) for _ in range(60)))
                         for i in range(12)] + [(60, "x ünder öl y"), (61, items[3][1]), (62, items[6][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.decontaminated(documents(texts), benchmark, block_windows=block).collect()
    assert len(found) == len(texts)
    for row in found:
        count, hit, which = plain_hits(row["row"]["text"], items)
        assert row["n_words"] == count
        assert sum(s["end_word"] - s["first_word"] for s in row["hit_words"]) == hit
        assert row["hit_items"] == which


def test_decontamination_cuts_by_original_offsets(spark, documents):
    item = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    text = "Éa -- ONE two, three four five six (seven) eight nine TEN eleven! End."
    found = decontamination.decontaminated(documents([(1, text), (2, None), (3, "clean")]), benchmark)
    clean = {r["doc_id"]: r["text"] for r in decontamination.without_hits(found).collect()}
    assert clean == {1: "Éa -- ! End.", 2: None, 3: "clean"}


# --- lines -----------------------------------------------------------------------


def test_line_dedup(documents):
    long = "This passage of more than six tokens recurs across documents."
    texts = [
        (1, f"First own line of the document.\n{long}\nshort\x01line\x02here\x03"),
        (2, f"Second own line with words. {long} And an end of six words here.\nshort"),
        (3, f"{long}"), (4, "Build 17 took 3 seconds on host 12 today.\nOwn words here now."),
        (5, "Build 99 took 8 seconds on host 77 today.\nOther own words here."), (6, None), (7, ""),
        (8, "twice in one text only now then.\ntwice in one text only now then."),
        (9, "Repeated row of this table."), (9, "Repeated row of this table."),
        (None, "Nameless words stand in this line."), (None, "Nameless words stand in this line."),
    ]
    found = line_dedup.deduplicated(documents(texts)).collect()
    kept = [(r["row"]["doc_id"], r["kept_text"]) for r in found]
    assert len(kept) == len(texts)
    by_id = dict(kept)
    assert by_id[1] == texts[0][1]
    assert by_id[2] == "Second own line with words. And an end of six words here.\nshort"
    assert by_id[3] == ""
    assert by_id[4] == texts[3][1] and by_id[5] == "Other own words here."
    assert by_id[6] is None and by_id[7] == ""
    assert by_id[8] == texts[7][1]
    assert [t for i, t in kept if i == 9] == [texts[8][1]] * 2
    assert [t for i, t in kept if i is None] == [texts[10][1]] * 2
    left = line_dedup.without_repetition(documents(texts))
    assert left.columns == documents([]).columns
    assert {r["doc_id"] for r in left.collect()} == {1, 2, 4, 5, 6, 7, 8, 9, None}


def test_line_dedup_keeps_rows_of_numbers(documents):
    rows = ["{0} {1} {2}", "{0}, {1}, {2}, {0}", "| {0} | {1} | {2} |", "2024-01-{0} 12:{1} {2}.5", "N {0}.1 E {1}.7 {2}",
            "{0} kg {1} cm {2}", "3 May 20{0} {1}:{2}"]
    texts = [(i, "\n".join(row.format(10 + i, 20 + i, 30 + i) for row in rows)) for i in range(4)]
    texts += [(10, texts[0][1] + "\n99 98 97"), (11, "Build 17 took 3 seconds on host 12 today."),
              (12, "Build 18 took 4 seconds on host 13 today.")]
    kept = {r["row"]["doc_id"]: r["kept_text"] for r in line_dedup.deduplicated(documents(texts)).collect()}
    assert [kept[i] for i in range(4)] == [t for _, t in texts[:4]]
    # Equal rows and templates of words are repeated as before.
    assert kept[10] == "99 98 97" and kept[11] == texts[5][1] and kept[12] == ""


def test_line_dedup_text_is_kept_to_the_letter(documents):
    draw = random.Random(3)
    signs = [".", "! ", "? ", ". ", "\n", " ", "\x01", "\x02", "\x03", "a", "b7", "ü", "\n\n", ".  "]
    texts = [(i, "".join(draw.choice(signs) for _ in range(80))) for i in range(30)]
    found = line_dedup.deduplicated(documents(texts)).where("n_dropped = 0").collect()
    assert found
    assert all(r["kept_text"] == r["row"]["text"] for r in found)


# --- tokens ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_bpe_is_the_library(vocabulary):
    path, library = vocabulary
    own = bpe.load(path)
    draw = random.Random(1)
    alphabet = "abcdefghijklmnopqrstuvwxyzéßñ'.,!?0123456789ABCZ"
    texts = ["".join(draw.choice(alphabet + "   ") for _ in range(120)) for _ in range(300)]
    texts += ["aaaaaaaaaaaaaaa hahahahaha", "İstanbul ΣΑΣ ﬁ ² Ⅷ", "é", "<|endoftext|>a<|startoftext|> <|x|>",
              "😀 日本語 it's !'s", "\x1c\x85\xa0a b", "...,,, ''s 're'", "\x00\x01", "a.b,c.", "."]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids if ids else own.entries(text) == []
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_last_tokens_are_unique(vocabulary):
    own = bpe.load(vocabulary[0])
    for token, name in list(own.names.items())[600:3000]:
        if name.endswith("</w>") and name[:-4].isascii() and name[:-4].isalpha():
            assert own.encode_word(name[:-4]) == [token]


def test_bpe_rows(documents, vocabulary):
    path, library = vocabulary
    texts = ODD_TEXTS + [(20, "Hello World, it's 2024"), (21, "one <|endoftext|> two")]
    found = bpe.encoded(documents(texts), path)
    for row in found.collect():
        ids = library.encode(row["row"]["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
    for row in bpe.decoded(found, path).collect():
        assert row["decoded"] == library.decode(row["ids"], skip_special_tokens=False)


def test_bpe_memory_is_bounded(monkeypatch, vocabulary):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = bpe.WordBpe(vocabulary[0])
    text = " ".join(f"word{i} other{'abc'[i % 3]}." for i in range(200))
    assert own.encode(text) == vocabulary[1].encode(text, add_special_tokens=False).ids
    assert max(len(own._new), len(own._old), len(own._word_entries)) <= 5


# --- URLs ------------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    return host.translate(LOWERED), re.match("[^?#]*", rest[len(host):]).group()


def test_globs_against_regular_expressions():
    draw = random.Random(2)
    globs = ["".join(draw.choice(["a", "b", "/", ".", "*", "**"]) for _ in range(draw.randint(1, 9))) for _ in range(60)]
    texts = ["".join(draw.choice("ab/.") for _ in range(draw.randint(0, 12))).encode() for _ in range(400)] + [b"a" * 3000]
    fits = url_filters.GlobAutomaton(globs).fits(texts)
    for j, glob in enumerate(globs):
        parts = [".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]", glob)]
        pattern = re.compile("".join(parts), re.S)
        assert [bool(pattern.fullmatch(t.decode())) for t in texts] == list(fits[:, j])


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://Example.NET/en/1?q#f", "http://example.net", "http://example.net/", "x://net/a",
            "http://a.example.net/EN/1", "https://www.b.org/fr/x", "https://borg/fr/", "http://fr.example.com/de/7#x",
            "http://notexample.com/de/", "http://example.com:80/de/", "http://h/" + "p" * 5000, "a://b://net/x", "http://ünet/",
            "http://x.ads.y/z", "http://x/ads.zip", "://net/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, host string")
    rows = url_filters.judged(pages).collect()
    assert len(rows) == len(urls) + 1
    for row in rows:
        host, path = plain_url(row["row"]["url"])
        assert (row["host"], row["path"]) == (host, path)
        fitting = [r for _, r in url_filters.HOST_RULES
                   if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        assert row["rule"] == (max(fitting, key=len) if fitting else None)
    verdicts = {r["row"]["url"]: r["verdict"] for r in rows}
    assert verdicts["http://x.ads.y/z"] == verdicts["http://x/ads.zip"] == "block" and verdicts[None] == "allow"
    assert url_filters.judged(pages.limit(0)).count() == 0


# --- personal data ---------------------------------------------------------------

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(
                    sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans():
    draw = random.Random(4)
    texts = ["".join(draw.choice("ab@@..1234+- ()é") for _ in range(60)) for _ in range(3000)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1111-", "+1 (555) 010-2233", "1.2.3.4.5.6.7.8", "0001.2.3.4 256.1.1.1",
              "a@b@c.d", "@@a.b", "٣.٣.٣.٣ +٣٣٣٣٣٣٣٣٣"]
    for text in texts:
        assert personal_data.base_spans(text) == plain_spans(text), text


def test_personal_rows(documents):
    text = "é mail a.b@c.de now, with password=8fa31c77b2e9aa here. Call 555-0142."
    found = personal_data.found(documents(ODD_TEXTS + [(9, text)]))
    rows = found.select("row.doc_id", "row.text", "base", "spans").collect()
    assert len(rows) == len(ODD_TEXTS) + 1
    for row in rows:
        base = [tuple(s) for s in row["base"]]
        assert base == plain_spans(row["text"] or "")
        assert set(base) <= {tuple(s) for s in row["spans"]}
    spans = {text[s["start"]:s["end"]]: s["kind"] for r in rows if r["doc_id"] == 9 for s in r["spans"]}
    assert spans["a.b@c.de"] == "email" and spans["password=8fa31c77b2e9aa"] == "secret"


def test_crf_leaves_prose_alone_and_decodes_like_whole_lines():
    crf = personal_data.train()
    assert crf.plain_is_safe
    rows = personal_data.labelled_rows()
    whole = personal_data.Crf(crf.features, crf.weights, crf.pairs)
    whole.plain_is_safe = False
    right = every = 0
    for own, labels in rows:
        data = " ".join(own).encode()
        import numpy as np
        starts = np.array([0, len(data)])
        pruned = personal_data._chunk_labels(crf, data, starts)[3]
        full = personal_data._chunk_labels(whole, data, starts)[3]
        assert list(pruned) == list(full)
        right += sum(crf.LABELS[a] == b for a, b in zip(pruned, labels))
        every += len(labels)
    assert right / every > 0.97
