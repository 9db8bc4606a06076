from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language, mixing, neardup, packing, repeated
from corpusloom.llm.tokens import TOKENIZER, load
from corpusloom.llm.tokens import Counter as TokenCounter

# ---- repeated lines ----


def repeated_slow(rows):
    """(id, line_no) by counting over all documents."""
    root = lambda r: r.strip().lower().split("://")[-1].removesuffix("/")
    docs = {i: (root(r), t or "") for i, t, r in rows if r is not None and i is not None}
    sizes, spans = Counter(r for r, _ in docs.values()), defaultdict(set)
    lines = []
    for i, (r, t) in docs.items():
        for n, line in enumerate(t.split("\n"), 1):
            k = repeated.line_key(line)
            if any(c.isalpha() for c in k):
                spans[r, k].add(i)
                lines.append((i, n, r, k))
    return sorted((i, n) for i, n, r, k in lines if len(spans[r, k]) >= 5 and len(spans[r, k]) * 20 >= sizes[r])


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_repeated_lines_equal_counting(spark, seed, partitions):
    rng = random.Random(seed)
    lines = ["Haut de page", "haut  de\tpage ", "Lu 12 fois", "Lu 7 fois", "---", "", "Imprimer\r", "a", "b"] + [f"x{i} ligne" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))), rng.choice(["http://h.test/", "https://H.test", "http://o.test/p", None])) for i in range(120)]
    rows += [(500 + i, None, "http://h.test") for i in range(10)] + [(None, "Haut de page", "http://h.test")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, rooturl string").repartition(5)
        assert sorted((r.doc_id, r.line_no) for r in repeated.repeated_lines(docs).collect()) == repeated_slow(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_blocks_and_deletion(spark):
    rows = [(i, f"Mentions légales\nDonnées personnelles\ntexte {chr(97 + i)}", "http://h") for i in range(8)]
    docs = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id bigint, text string, rooturl string")
    depth = {r.depth: r.docs for r in repeated.repeated_blocks(*repeated.suffix_rows(docs)).where("depth = 2").collect()}
    assert depth == {2: 8}  # rows that stand there three times count once
    clean = repeated.without_repeated_lines(docs.where("doc_id > 0")).collect()
    assert {r.doc_id: r.text for r in clean} == {i: f"texte {chr(97 + i)}" for i in range(1, 8)}
    assert repeated.repeated_lines(docs.limit(0)).count() == 0


def test_blocks_of_several_lines_are_not_lines_of_their_own(spark):
    """Depth 1 and 2 differ: lines that recur apart from each other are no block, and rules within a block go with it."""
    block = "Share this\n---\n\nPrint this\nClose this\nLeave this\nDrop this\nLast of this"
    rows = [(i, f"{block}\ntext {chr(97 + i)}\nAlone", "h") for i in range(6)] + [(10 + i, f"Alone\nother {chr(97 + i)}\nPrint this", "h") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rooturl string")
    got = sorted(tuple(r) for r in repeated.repeated_block_lines(docs).collect())
    assert got == [(i, n) for i in range(6) for n in range(1, 9)]  # six lines, a rule and a blank one
    single = {tuple(r) for r in repeated.repeated_lines(docs).collect()}
    assert (0, 10) in single and (12, 3) in single and (0, 2) not in single
    assert repeated.repeated_block_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [1, 2, 3, 4])
def test_any_bound_of_documents(spark, bound):
    rows = [(i, "\n".join(f"line {chr(97 + k)}" for k in range(6) if i < k + 1), "h") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rooturl string")
    want = sorted((i, n) for i in range(6) for n, k in enumerate(range(i, 6), 1) if k + 1 >= bound)
    assert sorted(tuple(r) for r in repeated.repeated_lines(docs, min_docs=bound, min_part=0.0).collect()) == want


# ---- near-duplicates ----


def jaccard(a: str, b: str, size: int) -> float:
    sets = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def corpus(seed: int, n: int = 60) -> dict[int, str]:
    rng, texts = random.Random(seed), {}
    for i in range(n):
        words = [f"w{rng.randint(0, 4000)}" for _ in range(120)]
        texts[i] = " ".join(words)
        for c in range(rng.randint(0, 2)):
            edited = list(words)
            for _ in range(rng.randint(0, 8)):
                edited[rng.randrange(len(edited))] = f"z{rng.randint(0, 999)}"
            texts[1000 + 3 * i + c] = " ".join(edited)
    return texts


def test_near_duplicates_against_all_pairs(spark):
    texts = corpus(4)
    docs = spark.createDataFrame([*texts.items(), (5000, None), (5001, "few words"), (None, texts[0])], "doc_id bigint, text string")
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if jaccard(texts[a], texts[b], 3) >= 0.6}
    members, links = neardup.near_duplicates(docs, 0.6, 3, 50, plain=True)
    got = {(r.doc_id_a, r.doc_id_b) for r in neardup.duplicate_pairs(members, links).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 20
    assert {r.id for r in members.collect()} == set(texts)


def test_the_weighted_similarity_decides(spark):
    """Texts that share what every text has and differ in what is rare are alike by sets and not by weights."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*common, *(f"r{i}x{k}" for k in range(20))])) for i in range(30)] + [(100, " ".join(f"w{k}" for k in range(90)))]
    rows.append((101, rows[-1][1] + " end"))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = {(r.a, r.b) for r in neardup.near_duplicates(docs, 0.55, 3, 5, plain=True)[1].collect()}
    links = neardup.near_duplicates(docs, 0.55, 3, 5)[1].collect()
    assert {(r.a, r.b) for r in links} == {(100, 101)} and all(r.weighted >= 0.55 for r in links)
    assert (100, 101) in plain and all(jaccard(dict(rows)[a], dict(rows)[b], 3) >= 0.55 for a, b in plain)


def test_short_and_missing_texts_have_a_class(spark):
    rows = [(1, "Few Words"), (2, "few  words"), (3, None), (4, ""), (5, " "), (6, "other words"), (7, "a b c d e f"), (8, "a b c d e f")]
    members, links = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), short=True)
    assert {r.id: r.rep for r in members.collect()} == {1: 1, 2: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7} and links.count() == 0


def test_copies_are_one_class(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i, text) for i in range(40)] + [(100, text.upper()), (101, text + " end")]
    members, links = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.id: r.rep for r in members.collect()} == {**{i: 0 for i in range(40)}, 100: 0, 101: 101}
    assert [(r.a, r.b) for r in links.collect()] == [(0, 101)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.duplicate_pairs(*neardup.near_duplicates(empty)).count() == 0


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    keys = np.arange(1, neardup.BANDS + 1, dtype=np.int64)
    rows = [(i, bytearray(np.where(keys == 1, 1, keys * 1000 + i).astype(np.int64).tobytes())) for i in range(23)]
    made = spark.createDataFrame([*rows, rows[3], rows[3], (50, None)], "content bigint, bands binary")
    got = sorted((r.a, r.b) for r in neardup.candidate_pairs(made).collect())
    assert got == list(itertools.combinations(range(23), 2))


def test_samples_estimate_weighted_similarity():
    rng, sampler = np.random.default_rng(1), neardup.Sampler()
    pool = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    levels = rng.integers(neardup.LOW_LEVEL, 16, len(pool)).astype(np.int32)
    errors = []
    for cut in (300, 450, 600):
        a, b = slice(0, cut + 200), slice(200, len(pool))
        p, q = np.exp2(levels / 4.0) * (np.arange(len(pool)) < cut + 200), np.exp2(levels / 4.0) * (np.arange(len(pool)) >= 200)
        true = np.minimum(p, q).sum() / np.maximum(p, q).sum()
        errors.append(abs((sampler.samples(pool[a], levels[a]) == sampler.samples(pool[b], levels[b])).mean() - true))
    assert max(errors) < 4 * math.sqrt(0.25 / neardup.SAMPLES)


def test_words_end_at_spaces_only():
    s = neardup.Shingler(1)
    assert s.words("A\tb\r\nc\x0bd\u00a0e f") == [b"a", b"b", "c\x0bd\u00a0e".encode(), b"f"]


# ---- languages ----

SAMPLES = [
    ("fr", "La banque complète le marché pour une durée limitée, parce que les clients l’ont demandé."), ("fr", "Le contrat protège la clientèle selon les premiers chiffres."),
    ("de", "Der Bericht regelt den Antrag nach den ersten Zahlen, damit jeder die Angebote vergleichen kann."), ("de", "Das Gutachten begründet die Prüfung seit Anfang des Jahres."),
    ("en", "The branch supports the budget for a limited period, because the customers asked for it."), ("en", "The report delays the account since the beginning of the year."),
    ("es", "El banco completa el mercado por un tiempo limitado, porque los clientes lo han pedido."), ("es", "La solicitud regula el contrato según los primeros datos."),
    ("it", "La banca completa il mercato per un periodo limitato, perché i clienti lo hanno chiesto."), ("it", "Il rapporto disciplina la domanda secondo i primi dati."),
]


@pytest.fixture(scope="module")
def tagger():
    return language.train(SAMPLES, [("fr", "le"), ("de", "der"), ("en", "the"), ("es", "el"), ("it", "il")])


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    e, move, start = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    marginals, pairs, log_z = language.forward_backward(e, mask, move, start)
    want_pairs = np.zeros((3, 3))
    for b, n in enumerate((4, 2)):
        weight = {y: math.exp(start[y[0]] + sum(e[b, i, y[i]] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product(range(3), repeat=n)}
        z = sum(weight.values())
        assert log_z[b] == pytest.approx(math.log(z))
        for i in range(n):
            assert marginals[b, i] == pytest.approx([sum(w for y, w in weight.items() if y[i] == k) / z for k in range(3)])
        for y, w in weight.items():
            for i in range(n - 1):
                want_pairs[y[i], y[i + 1]] += w / z
    assert pairs == pytest.approx(want_pairs)


def test_held_out_sentences(tagger):
    held = {
        "fr": "Le marché protège la banque selon les clients de la clientèle.", "de": "Der Antrag regelt das Gutachten nach dem Bericht des Jahres.", "en": "The customers asked the branch for the report of the year.",
        "es": "El contrato regula el mercado según los clientes del banco.", "it": "Il mercato disciplina la banca secondo i clienti del rapporto.",
    }
    sums = tagger.line_sums([tagger.ids(language._WORD.findall(t.lower())) for t in held.values()])
    assert [language.LANGUAGES[k] for k in sums.argmax(axis=1)] == list(held)


@pytest.mark.parametrize(("label", "want"), [(" FR", "fr"), ("de_CH", "de"), ("en-EN", "en"), (None, None), ("", None), ("?", None), ("xx", None), ("und", None), ("nl", None)])
def test_labels(label, want):
    assert language.named_language(label) == want


def test_document_languages(spark, tagger):
    fr, de = SAMPLES[0][1], SAMPLES[2][1]
    rows = [
        (1, fr, "fr-FR", "a"), (2, fr, "en", "a"), (3, f"{fr}\n{fr}\n{de}\n| a | 1 | 2 | 3 | 4 | 5 | 6 |", "fr", "a"), (4, fr, None, "a"), (5, "§§ x7q/ 99", "fr", "a"),
        (6, None, None, "a"), (7, "nginx", None, "a"), (None, fr, None, "a"), (2, fr, "en", "a"),
    ]
    docs = spark.createDataFrame([(i, t, None, lang, s, 1) for i, t, lang, s in rows], "doc_id bigint, text string, title string, lang string, source string, confidence int")
    found = language.label_faults(language.document_languages(docs, tagger, [t for _, t in SAMPLES], without_residue=True))
    assert sorted(map(tuple, found.collect())) == [(2, 0, "fr"), (3, 3, "de"), (4, 0, "fr")]
    everything = language.document_languages(docs, tagger, [t for _, t in SAMPLES])
    assert all(0.5 < r.confidence <= 1 for r in everything.where("line_no = 0 AND doc_id < 5").collect())


def test_stretches_in_another_language(spark, tagger):
    fr, de, en = SAMPLES[0][1], SAMPLES[2][1], "The report delays the account."
    whole = f"{de.rstrip('.')}; {de.rstrip('.')}; {de}"
    lines = [f"{fr} {fr}", f"{fr} {de}", en, whole]
    docs = spark.createDataFrame([(1, "\n".join([fr] * 6 + lines), None, "fr", "s"), (2, None, None, "fr", "s")], "doc_id bigint, text string, title string, lang string, source string")
    rows = language.document_languages(docs, tagger, [t for _, t in SAMPLES], stretches=True).collect()
    runs = [r for r in rows if r.line_no]
    n = len(language._WORD.findall(fr)), len(language._WORD.findall(f"{fr} {de}"))
    inside = [r for r in runs if r.line_no == 8 and r.lang == "de"]
    assert max(r.end for r in inside) == n[1] and abs(min(r.start for r in inside) - n[0] - 1) <= 1
    assert [(r.start, r.end, r.lang) for r in runs if r.line_no == 9] == [(1, 5, "en")]
    assert all(0.2 < r.confidence <= 1 for r in runs) and not [r for r in runs if r.line_no < 8]
    assert [(r.start, r.end, r.lang) for r in rows if not r.line_no] == [(None, None, "fr")]
    found = language.label_faults(language.document_languages(docs, tagger, [t for _, t in SAMPLES]))
    assert (1, 10, "de") in set(map(tuple, found.collect()))


# ---- tokens, packing, mixing ----


@pytest.fixture(scope="module")
def count(spark):
    return TokenCounter(load(spark).value)


def test_stretches_do_not_change_counts(spark, count, monkeypatch):
    text = "Le marché  étendu, l’agence (2023) don't\n\n" * 400
    whole = count(text)
    monkeypatch.setattr(TokenCounter, "STRETCH", 97)
    assert count(text) == whole > 1000


def specs(spark, rows):
    return spark.createDataFrame(rows, "pack_name string, capacity_tokens int, separator_tokens int")


def test_best_fit_fills():
    rng = random.Random(5)
    for _ in range(100):
        capacity, separator = rng.randint(5, 60), rng.randint(0, 3)
        sizes = [rng.randint(0, capacity) for _ in range(rng.randint(1, 80))]
        bins = packing.best_fit([(s, [(i, 0, s)]) for i, s in enumerate(sizes)], capacity, separator)
        for used, items in bins:
            assert used == sum(t for _, _, t in items) + separator * (len(items) - 1) <= capacity
        assert sorted(i for _, items in bins for i, _, _ in items) == list(range(len(sizes)))
        loose = [u for u, _ in bins if 2 * u + separator <= capacity]
        assert len(loose) <= 1  # two half-empty containers would have been joined


def test_pieces():
    assert packing.pieces(5, 5) == [5] and packing.pieces(12, 5) == [5, 5, 2] and packing.pieces(10, 5) == [5, 5] and packing.pieces(0, 5) == [0]


def test_packing(spark, count, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    rng = random.Random(6)
    texts = {i: " ".join(rng.choice(["banque", "le", "marché", "budget", "x1"]) for _ in range(rng.randint(0, 90))) for i in range(300)}
    rows = [*texts.items(), (900, None), (None, "x"), (901, "a b " * 500)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, tokens int")
    table = specs(spark, [("a", 128, 1), ("b", 40, 0), ("bad", 0, 0)])
    placed = packing.pack_documents(docs, table).collect()
    for name, capacity, separator in (("a", 128, 1), ("b", 40, 0)):
        own = [r for r in placed if r.pack_name == name]
        bins, whole = defaultdict(list), Counter()
        for r in own:
            bins[r.container_id].append(r.tokens)
            whole[r.doc_id] += r.tokens
        assert all(sum(b) + separator * (len(b) - 1) <= capacity for b in bins.values())
        assert whole == {i: count(t) for i, t in rows if i is not None and t is not None}
        assert all(n == 1 for i, n in Counter(r.doc_id for r in own).items() if count(dict(rows)[i]) <= capacity)
        least = math.ceil(sum(whole.values()) / capacity)
        assert len(bins) <= 1.12 * least + 2
    assert {r.pack_name for r in placed} == {"a", "b"}
    report = {r.pack_name: r.fill for r in packing.packing_report(packing.pack_documents(docs, table), table).collect()}
    assert all(0.85 < f <= 1 for f in report.values())
    assert packing.pack_documents(docs.limit(0), table).count() == 0


def test_water_filling():
    S = mixing.Source
    assert mixing.water_fill([S(0.5, 100, 1), S(0.5, 1000, 1)]) == [100, 100]
    assert mixing.water_fill([S(0.5, 100, 1), S(0.25, 1000, 1), S(0.25, 1000, 1)], 1000) == [100, 450, 450]
    assert mixing.water_fill([S(0.5, 100, 3), S(0.5, 0, 9)], 200) == [200, 0]
    assert mixing.water_fill([S(1.0, 10, 2)], 500) == [20] and mixing.water_fill([S(1.0, 0, 2)]) == [0] and mixing.water_fill([]) == []
    rng = random.Random(7)
    for _ in range(200):
        own = [S(rng.random(), rng.choice([0, rng.randint(1, 99)]), rng.randint(0, 4)) for _ in range(6)]
        given = mixing.water_fill(own, 150)
        assert all(g <= s.available * s.max_repeats + 1e-6 for g, s in zip(given, own, strict=True))
        free = [(g / s.share) for g, s in zip(given, own, strict=True) if 0 < g < s.available * s.max_repeats - 1e-6]
        assert not free or max(free) - min(free) < 1e-6 * max(free)


@pytest.mark.parametrize("classes", [1, 64])
def test_mixing(spark, count, monkeypatch, classes):
    monkeypatch.setattr(mixing, "CLASSES", classes)
    rng = random.Random(8)
    rows = [(i, " ".join(["marché"] * rng.randint(5, 60)), "big" if i % 10 else "small") for i in range(400)] + [(900, None, "big"), (901, "x", "none"), (None, "x", "big")]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id bigint, text string, source string, tokens int")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.4, 3), ("m", "gone", 0.1, 2)], "mix_name string, source string, target_share double, max_repeats int")
    mixed, report = mixing.mix_sources(docs, targets)
    by = {r.source: r for r in report.collect()}
    have = Counter()
    for r in mixed.collect():
        have[r.source] += r.tokens * r.repeats
        assert 1 <= r.repeats <= {"big": 1, "small": 3}[r.source] and r.tokens == count(dict((i, t) for i, t, _ in rows)[r.doc_id])
    assert by["gone"].actual_share == 0 and by["small"].capped
    assert by["big"].actual_share == pytest.approx(5 / 9, abs=0.01) and by["small"].actual_share == pytest.approx(4 / 9, abs=0.01)
    assert all(by[s].tokens == n for s, n in have.items())
    again = {(r.doc_id, r.repeats) for r in mixing.mix_sources(docs, targets)[0].collect()}
    assert again == {(r.doc_id, r.repeats) for r in mixed.collect()}


def test_only_named_columns_are_read(spark):
    docs = spark.createDataFrame([(1, "t", "a", "b", "c", 2)], "doc_id bigint, text string, rep string, key string, bands string, n int")
    members, links = neardup.near_duplicates(docs, min_words=1, size=1)
    assert members.count() == 1 and links.count() == 0


def test_tokenizer_path_is_checked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("corpusloom.llm.tokens.MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError, match="larger"):
        load(spark, TOKENIZER)


def test_no_collect_of_documents(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("http://h").alias("rooturl"))
    assert repeated.repeated_lines(docs, min_docs=2).count() == 3


def test_labelled_words_of_a_bounded_sample(spark):
    rows = [(i, "matelas promo Dorval", "fr", 1) for i in range(12)] + [(100 + i, "removals promo Dorval", "en_GB", 1) for i in range(12)]
    rows += [(200, "matelas", "en", 1), (201, None, "fr", 1), (202, "x", None, 1), (None, "x", "fr", 1), (203, "matelas", "xx", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, label int")
    assert language.labelled_words(docs) == [("fr", "matelas"), ("en", "removals")]
    assert language.labelled_words(docs, most=2) == [] and language.labelled_words(docs.limit(0)) == []


def test_close_call_keeps_the_named_language(spark, tagger):
    docs = spark.createDataFrame([(1, "zorvat plimex quolst mertin vabrun doltek", None, lang, "s") for lang in ("fr", "it")], "doc_id bigint, text string, title string, lang string, source string")
    rows = language.document_languages(docs, tagger, ["zorvat plimex quolst mertin vabrun doltek"]).collect()
    close = [r for r in rows if r.lang == r.named]
    assert len(rows) == 2 and len(close) >= 1


def test_faults_of_packings_and_mixes_are_seen(spark):
    table = specs(spark, [("a", 10, 1)])
    docs = spark.createDataFrame([(i, "x") for i in range(4)], "doc_id bigint, text string")
    good = [("a", "c1", 0, 0, 4), ("a", "c1", 1, 0, 5), ("a", "c2", 2, 0, 9)]
    ddl = "pack_name string, container_id string, doc_id bigint, piece_no int, tokens bigint"
    see = lambda rows: tuple(packing.packing_faults(docs, spark.createDataFrame(rows, ddl), table).first())
    assert see(good) == ("a", 3, 0, 0, 0)
    assert see([*good, ("a", "c2", 3, 0, 2)])[2] == 1 and see([*good, ("a", "c3", 3, 0, 2), ("a", "c4", 3, 1, 2)])[3] == 1
    assert see([("a", f"c{i}", i, 0, 1) for i in range(9)])[4] > 0


def test_a_mix_of_everything_clamps_small_sources(spark):
    rows = [(i, "marché banque " * 9, "big") for i in range(300)] + [(900 + i, "marché banque " * 9, "small") for i in range(10)] + [(2000 + i, "marché banque " * 9, "mid") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("m", "big", 0.25, 2), ("m", "small", 0.5, 3), ("m", "mid", 0.25, 2)], "mix_name string, source string, target_share double, max_repeats int")
    mixed, report = mixing.mix_sources(docs, targets, mixing.EVERYTHING)
    by = {r.source: r for r in report.collect()}
    assert by["small"].capped and by["small"].epochs == 3 and by["small"].most_repeats == 3
    assert by["big"].tokens == pytest.approx(by["mid"].tokens, rel=0.02) and sum(r.tokens for r in by.values()) == pytest.approx(sum(r.available for r in by.values()), rel=0.01)
    assert not [r for r in mixing.mixing_faults(report).collect() if r.repeated or r.missed or r.unfair]
    worse = report.withColumn("tokens", F.expr("IF(source = 'mid', tokens * 2, tokens)"))
    assert [r.source for r in mixing.mixing_faults(worse).collect() if r.missed] == ["mid"]
