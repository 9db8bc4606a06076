from __future__ import annotations

import itertools
import random

import pytest

from corpusloom.llm import boilerplate, mojibake, quality, residue, spam
from corpusloom.llm.page import FRAME, Classifier, Page, minimum_cut

PAGE = """Nous utilisons des cookies afin d’améliorer votre visite.
- Accueil
- Tarifs

Accueil › Actualités › crédit
# Le crédit
Par la rédaction de Dremaric
Le contrat protège la banque, parce que les clients l’ont demandé. Le délai reste le même pour tous.
Les plus lus
› Budget 2018 – banque
- Contrat - l’enquête locale
- relevé général sans l’agence
Le marché complète la prime depuis le début de l’année, mais les effets restent limités.
Haut de page\r
© 2020 Dremaric. Tous droits réservés."""


def frame(text, title=None):
    page = Page(text, title, Classifier())
    return [n for n, out in zip(page.numbers, page.frame, strict=True) if out]


def test_frame_of_a_page():
    assert frame(PAGE, "Le crédit") == [1, 2, 3, 5, 7, 9, 10, 11, 14, 15]
    assert frame(PAGE.upper(), "Le crédit") == [1, 2, 3, 5, 7, 9, 10, 11, 14, 15]


@pytest.mark.parametrize("text", [None, "", "\n\n", "   ", "Only prose here, without any frame around it at all."])
def test_nothing_to_cut(text):
    assert frame(text) == []


def test_wrongly_decoded_frame():
    assert frame("Gérer mes préférences de confidentialité\nDu texte.".encode().decode("cp1252", "replace")) == [1]
    assert frame("Suivez Dremaric sur les r�seaux\nDu texte suivi.") == [1]


def test_messages_by_place():
    body = "Le contrat protège la banque, parce que les clients l’ont demandé."
    notice = "Veuillez activer JavaScript pour afficher cette page."
    assert frame(f"{notice}\n# Titre\n{body}\n{body}") == [1]
    assert frame(f"# Titre\n{notice}\n{body}\n{body}") == [2]
    error = "Une erreur interne est survenue."
    assert frame(f"# Titre\n{body}\n{error}\n{body}") == []
    assert frame(notice) == [] and frame(f"{notice}\nHaut de page") == [2]


@pytest.mark.parametrize("more", range(0, 12))
def test_notices_of_any_length(more):
    notice = "We use cookies to improve your visit." + " You can change your choice at any time in the settings of this page." * more
    assert frame(f"{notice}\n# Head\nThe team funds the transfer, because the customers asked for it.") == [1]


def test_long_prose_about_cookies_is_content():
    text = "The report says that many pages set more trackers than they need, and that we use cookies without thinking. " * 4
    assert frame(f"Home\n# Head\n{text}\n{text}") == [1]


@pytest.mark.parametrize("entries", range(1, 13))
def test_boxes_of_references_have_any_number_of_entries(entries):
    box = "\n".join(f"- Additional insurer {2000 + i} – shared reform" for i in range(entries))
    body = "The detailed team funds the regional transfer, because the customers asked for it."
    assert frame(f"# Head\n{body}\nRead also\n{box}\n{body}") == list(range(3, 4 + entries))


def test_a_list_after_a_box_is_content():
    entries = "\n".join(f"Insurer {2000 + i} – shared reform" for i in range(60))
    assert len(frame(f"# Head\n{entries}\nRead also\n- Tariff – reform\n{entries}")) < 12


def test_minimum_cut_is_least():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 7)
        score = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda y: sum(max(0, s) * (not v) + max(0, -s) * v for s, v in zip(score, y, strict=True)) + sum(c for a, b, c in edges if y[a] != y[b])  # noqa: E731,B023
        assert cost(minimum_cut(score, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_long_page_is_linear():
    text = "\n".join(["Accueil", "Le contrat protège la banque, parce que les clients l’ont demandé."] * 60_000)
    assert len(frame(text)) == 60_000


def test_classifier_memory_is_bounded():
    kind = Classifier(bound=10)
    assert [kind(f"Tarifs {i}") for i in range(50)] and len(kind.memory) <= 10 and kind("Tarifs") == FRAME


def documents(spark, rows):
    full = [(i, t, "Titre", "s", None, "http://r/", 1) for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, title string, source string, lang string, rooturl string, id int")


def test_frame_lines(spark):
    docs = documents(spark, [(1, PAGE), (2, None), (None, "Accueil"), (1, PAGE), (3, "")])
    got = boilerplate.frame_lines(docs)
    assert got.columns == ["doc_id", "line_no"] and got.dtypes == [("doc_id", "bigint"), ("line_no", "int")]
    rows = [(r.doc_id, r.line_no) for r in got.collect()]
    assert rows.count((1, 1)) == 2 and (None, 1) in rows and len(rows) == 21
    assert boilerplate.frame_lines(docs.limit(0)).count() == 0
    assert {r.doc_id: r.main_text for r in boilerplate.main_text(docs).where("doc_id > 1").collect()} == {2: None, 3: ""}


# ---- residue ----


@pytest.mark.parametrize(
    "line",
    ["Le {{ name }} couvre", "# Projet - le [[amount]]", "${product_name} @@AUTHOR@@", "prix %%PRICE%%", "<%= contactEmail %>", "{% amount %}", "{author} dit", "voir [link] ici", "#{user.firstname}", "[Insert company name]", "$TITLE$ news", "hello __NAME__", "[votre nom ici]"],
)
def test_placeholders(line):
    assert residue.has_placeholder(line)


@pytest.mark.parametrize("line", ["La balise “{{name}}” sert d’exemple", "la notation « {{ x }} » indique", "Das Zeichen `${value}` dient", "renvoi [21]", "[montre](https://a.example/1)", "{ }", "50 % des %%", "[dft] 35", "**__bold__** text", "$5 or $6$", "[company report](https://a.example/1)"])
def test_no_placeholders(line):
    assert not residue.has_placeholder(line)


def test_unknown_messages_come_out_of_groups(spark):
    body = "The detailed team funds the regional transfer, because the customers asked for it. It goes on."
    rows = [(i, "This content is not for your place", None, f"s{i}") for i in range(4)]
    rows += [(10 + i, f"This shared line is not for your place\n{body}\n{body}\n{body}", None, f"s{i}") for i in range(4)]
    rows += [(20, "Connection timed out while contacting upstream", None, "a"), (21, f"# T\nLoading…\n{body}\n{body}", "T", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, title string, source string")
    assert sorted(r.doc_id for r in residue.residue_documents(docs).collect()) == [0, 1, 2, 3, 20]


def test_long_messages_keep_their_keys_apart(spark):
    head = "Undefined index: id in a very long path " + "/var/www" * 40
    signs = residue.residue_signs(spark.createDataFrame([(1, head + " one", None, "a"), (2, head + " two", None, "a")], "doc_id bigint, text string, title string, source string"))
    assert signs.select("key").distinct().count() == 2


def test_residue_documents(spark):
    good = "Un administrateur reçoit parfois un message d’erreur 404 et cherche d’où vient le lien cassé. Le budget suit."
    odd = "The server at gate {} is asleep, come back"
    docs = spark.createDataFrame(
        [
            (1, "Erreur 404 : la page demandée est introuvable.", None, "a"), (2, good, None, "a"), (3, "Lorem ipsum dolor sit amet elit anim aliquip laborum", None, "a"),
            (4, f"# T\n{good}\nLe {{{{ rate }}}} couvre la banque.", "T", "a"), (5, odd.format(1), None, "a"), (6, odd.format(22), None, "b"), (7, odd.format(3), None, "c"),
            (8, "A session page nobody else has", None, "c"), (9, None, None, None), (None, "nginx", None, "a"), (1, "Erreur 404 : la page demandée est introuvable.", None, "a"), (10, "nginx", None, None),
        ],
        "doc_id bigint, text string, title string, source string",
    )
    assert sorted(r.doc_id for r in residue.residue_documents(docs).collect()) == [1, 3, 4, 5, 6, 7, 10]
    assert residue.residue_documents(docs.limit(0)).count() == 0
    found = {r.message: (r.n_sources, r.n_docs) for r in residue.residue_messages(residue.residue_signs(docs)).collect()}
    assert found["the server at gate 0 is asleep, come back"] == (3, 3)


# ---- spam ----

PROSE = "La clôture complète le marché, parce que les clients l’ont demandé. Il reste 12 jours pour déposer une réclamation à Dorval, dont le détail figure en annexe du rapport annuel."


@pytest.mark.parametrize(
    "text",
    [
        "matelas Berdor pas cher\n" + ", ".join(["matelas Berdor promo", "montre Berdor discount", "matelas Valgno avis"] * 12),
        "\n".join(f"- [montre Berdor promo](https://berdor.example/{i}/x)" for i in range(12)),
        "titre\n" + " ".join(["#matelasBerdor", "#montrePasCher", "#matelasPromo"] * 15),
        PROSE + "\n" + "Avec montre Berdor promo, profitez de montre Berdor promo et de matelas Berdor promo tout de suite. " * 8,
    ],
)
def test_spam(text):
    assert spam.is_spam(Page(text, None, Classifier()))


@pytest.mark.parametrize("text", [PROSE, PROSE + "\n" + "\n".join(f"- facture {a} sans {b}" for a, b in itertools.product("abcde", "vwxyz")), "", "\n".join(f"| banque {i} | {i} € | 20{i} |" for i in range(10, 40))])
def test_no_spam(text):
    assert not spam.is_spam(Page(text, None, Classifier()))


def test_spam_documents(spark):
    stuffed = "matelas Berdor promo, " * 40
    got = spam.spam_documents(documents(spark, [(1, stuffed), (1, stuffed), (2, PROSE), (3, None), (None, stuffed)]))
    assert [r.doc_id for r in got.collect()] == [1]


def test_recurrence_by_gap():
    near = spam.recurrence("a1 b1".split() * 20)
    assert near[1] > 0.9 and near[2] == 1.0
    far = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)] * 2
    assert spam.recurrence(far)[1] == 0.0


CYCLE = [f"w{a}{b}" for a, b in itertools.product("abcdefghij", "klmnopqr")]  # 80 words


@pytest.mark.parametrize(
    "text",
    [
        " ".join(CYCLE * 10),
        "\n".join(" ".join(CYCLE[i : i + 16]) for i in range(0, 80, 16)) * 3,
        " ".join(f"{w} de la {v}." for w, v in zip(CYCLE[::2], CYCLE[1::2], strict=True)) * 4,
        " ".join([a + b for a, b in itertools.product(CYCLE[:30], "abcdefghijklmnopqrst")] * 3),
    ],
)
def test_cycles_longer_than_the_near_lags_are_spam(text):
    assert spam.is_spam(Page(text, None, Classifier()))


@pytest.mark.parametrize("separator", [" | ", "; ", " · ", "   ", " "])
def test_noun_lists_with_any_separator_are_spam(separator):
    nouns = "montre matelas banque facture budget réseau crédit prime contrat marché clôture annexe".split()
    readable = quality.Readable([" ".join(nouns)])
    assert spam.is_spam(Page(separator.join(nouns) + "\n" + separator.join(reversed(nouns)), None, Classifier()), readable)
    assert not spam.is_spam(Page("khww nnmqqrd fksrjjvxh lmdkslqzp chfgxpk dz jwjf ptzz wdqjwt jfhzwjrwj jrk httjf", None, Classifier()), readable)


def test_dominant_lag_of_far_cycles():
    _, _, regular, _, recurring, lag = spam.recurrence(CYCLE * 10)
    assert regular == 1.0 and recurring == pytest.approx(0.9) and lag == 80
    rng = random.Random(3)
    assert spam.recurrence([rng.choice(CYCLE) for _ in range(4_000)])[2] < spam.REGULAR


# ---- quality ----

COMMON = frozenset(("le", "la", "the"))


def slow(text: str) -> tuple:
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    words = text.split()
    ends = (".", "!", "?", "…", ":", ";", "»", "”", '"')
    return len(text), len(words), sum(map(len, words)), len(lines), sum(x.endswith(ends) for x in lines), sum(w.lower().strip(".,;:!?'’\"()«»“”-") in COMMON for w in words)


def test_counts_do_not_depend_on_chunks():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("le la.\n \t,é5$") for _ in range(rng.randint(0, 40)))
        want = slow(text)
        for chunk in (1, 2, 3, 5, 100):
            c = quality.text_counts(text, COMMON, chunk)
            assert (c.chars, c.words, c.word_chars, c.lines, c.ended, c.common) == want, (text, chunk)


def test_statistics(spark):
    docs = documents(spark, [(1, "Le chat dort. " * 30), (2, None), (3, ""), (4, "§§ %% ##")])
    by = {r.doc_id: r for r in quality.quality_statistics(docs, ["le", "la"]).collect()}
    assert by[1].n_words == 90 and by[1].prose and by[1].common_word_ratio == pytest.approx(1 / 3)
    assert by[2].n_words == 0 and by[2].symbol_ratio is None and not by[4].prose


def test_kinds(spark):
    sample = ["le contrat protège la banque et la clientèle", "le marché complète la prime", "budget projet réseau facture crédit", PROSE]
    rng = random.Random(1)
    junk = "\n".join("".join(rng.choice("qxzvk79#§°/+ ") for _ in range(60)) for _ in range(9))
    items = "\n".join(f"- {a} : {b}" for a, b in itertools.product(["contrat", "banque", "marché"], ["prime", "crédit", "budget"]))
    rows = "\n".join(f"| banque | {i} € | 20{i} |" for i in range(10, 22))
    docs = documents(spark, [(1, items), (2, rows), (3, junk), (4, PROSE), (5, None), (6, "nginx"), (7, "matelas Berdor promo, " * 40), (8, items + "\nnginx"), (9, rows.replace(" | ", ";").strip("| "))])
    assert {r.doc_id: r.kind for r in quality.document_kinds(docs, sample).collect()} == {1: "list", 2: "table", 3: "junk", 9: "table"}


def test_kinds_do_not_depend_on_chunks():
    readable = quality.Readable(["le contrat protège la banque et la clientèle", "budget projet réseau facture crédit", PROSE])
    rng = random.Random(5)
    parts = ["# Budget", "- contrat : banque", "a | b | 3", "banque\t12", "budget;projet;facture", PROSE, PROSE * 2, "qx7§ z9k# vv", "Le contrat protège la banque et le budget."]
    for _ in range(200):
        lines = [rng.choice(parts) for _ in range(rng.randint(0, 7))]
        alone = quality._with_lines(quality.Shapes(), lines, readable)
        for chunk in (1, 2, 7, 50, 10_000):
            c = quality.body_shapes(lines, readable, chunk)
            assert c[:7] == alone[:7], (lines, chunk)
            assert c.text[0] + c.headings[0] == len(lines)
            assert quality.kind_of_shapes(c) == quality.kind_of_shapes(alone)


# ---- wrong decodings ----

CLEAN_LINES = ["L’échéance européenne garantit à Noël la clôture – où l’été coûte 45 €.", "Der Außenvermerk verändert die Prüfänderung über Jahre.", "La compañía electrónica está aquí, ¿no?", "Così perché la società è più sicura."]


@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("cp1252", "cp1251"), ("cp850", "cp1252"), ("mac_roman", "cp1252")])
def test_decodings_are_found_and_restored(written, read):
    repairer, whole = mojibake.Repairer(), 0
    for line in CLEAN_LINES:
        try:
            bad = line.encode(written).decode(read)
        except UnicodeError:
            continue
        found = repairer.check(bad)
        assert found, (written, read, bad)
        whole += found[0][2] == line
    assert whole >= 1 or written != "utf-8"


def test_twice_decoded():
    bad = "La clôture européenne".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.Repairer().check(bad)[0][2] == "La clôture européenne"


def test_clean_text_is_left_alone():
    lines = [*CLEAN_LINES, *(x.upper() for x in CLEAN_LINES), "São Torro, Noël ; « où » “long”… ✅ 😀", "DÛ, PRÊT, CÔTE À CÔTE", "É", "§ 12 °C £5 1ª ½", "ENTREPÔT NAUMARMA"]
    assert mojibake.Repairer().check("\n".join(lines)) == []


def test_only_garbled_spans_change():
    text = "La clôture est « sûre ».\nLa clÃ´ture est « sûre ».\nr�seau"
    assert mojibake.Repairer().check(text) == [(2, "La clÃ´ture est « sûre ».", "La clôture est « sûre »."), (3, "r�seau", "r�seau")]


def test_garbled_lines(spark):
    docs = documents(spark, [(1, "clÃ´ture\nok"), (2, None), (3, ""), (1, "clÃ´ture\nok")])
    assert [(r.doc_id, r.line_no, r.restored) for r in mojibake.garbled_lines(docs).collect()] == [(1, 1, "clôture")] * 2


def test_long_texts_are_counted_in_parts(spark):
    long = "Le chat dort la nuit, " * 5_000 + "x" * 70_000 + " fin."
    docs = documents(spark, [(1, long), (2, "Le chat."), (1, long), (None, long), (3, None)])
    for chunk in (1_000, 1 << 16, 1 << 24):
        got = sorted((r.doc_id or 0, r.n_words, r.mean_word_length, r.common_word_ratio) for r in quality.quality_statistics(docs, ["le", "la"], chunk=chunk).collect())
        words = long.split()
        want = (len(words), pytest.approx(sum(map(len, words)) / len(words)), pytest.approx(10_000 / len(words)))
        assert len(got) == 5 and [g[1:] for g in got if g[0] < 2] == [want] * 3


def test_an_open_word_keeps_few_letters():
    parts = [quality.count("x" * 1_000, frozenset()) for _ in range(50)]
    whole = quality.tree(parts, frozenset())
    assert len(whole.head) <= quality.KEEP and whole.head_n == 50_000 and quality.close(whole, frozenset()).word_chars == 50_000
