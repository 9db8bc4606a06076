"""Problem 7: only garbled spans change."""

import random

import pytest

from corpusloom.llm.mojibake import PAIRS, Repairer, _garble, repaired

CLEAN_LINES = [
    "Привет, мир. Это русский текст с буквой ё и словом ГЁТЕ.", "Київ, Гірка, її, ґанок", "Łódź żółć. Zażółć gęślą jaźń. W Gdańsku i Toruniu są ładne kamienice.",
    "Příliš žluťoučký kůň úpěl ďábelské ódy. Beneš a Čapek žijí v Brně.", "Ελλάδα, η γλώσσα των Ελλήνων — καλημέρα κόσμε.", "Œuvre et œuf, l’Œdipe. “quote” and ‘single’ ‚zitiert‘ „so“ …",
    "Îles et Ïle, Éire, Ô ciel", "Die Firma sagte ‚ja‘ und „nein“. Straße, ÄÖÜ, GROẞ", "Årsrapport på dansk: blå ål, ærø, øl. Sverige Åland", "İstanbul'da ığdır şişli çağrı ğ",
    "São Paulo não é NÃO. ESPAÑA… NIÑO", "Lech Wałęsa was born in Popowo; Dvořák composed in Spillville. Gdańsk is a port.", "The café in Gdańsk, Poznań and Toruń is nice.",
    "┌─┬─┐\n│a│b│\n├─┼─┤\n└─┴─┘", "x ≤ y, √2 ≈ 1.41, ∞", "Ða Ýmir þetta er íslenska: það, við, Þór", "Čeština: kůň. Also Karel Čapek", "ÉTÉ À LA PLAGE, MÊME À NOËL…",
    "Prix : 5 000 € · 20 °C – 30 % ; n° 5 § 12", "Côte d’Ivoire… oui…non",
]


@pytest.mark.parametrize("line", CLEAN_LINES)
def test_clean_text_of_any_language_stays(line):
    repairer = Repairer()
    assert repairer.check(line) == []
    assert repaired("plain\n" + line, repairer) == "plain\n" + line


def test_only_matched_words_of_a_line_change():
    ((number, _, restored),) = Repairer().check("Îles et Ïle, caf‚ ferm‚ en Éire “quote” Œuvre")
    assert (number, restored) == (1, "Îles et Ïle, café fermé en Éire “quote” Œuvre")


def test_lines_of_one_text_may_have_different_encodings():
    text = "la sociÃ©tÃ© gÃ©nÃ©rale\nl'‚quipe concern‚e protŠge le catalogue\nLa prime rйgionale contrфle le guichet\nПривет, мир"
    made = {n: s for n, _, s in Repairer().check(text)}
    assert made == {1: "la société générale", 2: "l'équipe concernée protège le catalogue", 3: "La prime régionale contrôle le guichet"}


def test_planted_lines_are_found_and_restored():
    words = "été société générale où déjà über Größe Straße año señor perché città forêt garçon naïf cœur müssen könnten así también".split()
    rng = random.Random(7)
    found = total = restored = 0
    repairer = Repairer()
    for written, read in PAIRS:
        for _ in range(40):
            clean = " ".join(rng.choice(words) for _ in range(12))
            garbled = _garble(clean, written, read)
            if garbled is None or garbled == clean:
                continue
            total += 1
            got = repairer.check(f"A first line.\n{garbled}")
            found += bool(got) and got[0][0] == 2
            restored += bool(got) and got[0][2] == clean
    assert total > 400
    assert found >= 0.98 * total
    assert restored >= 0.8 * total


def test_other_alphabets_read_as_latin_are_restored():
    assert Repairer().check("ÐŸÑ€Ð¸Ð²ÐµÑ‚, Ð¼Ð¸Ñ€")[0][2] == "Привет, мир"
    assert Repairer().check("ZaÅ¼Ã³Å‚Ä‡ gÄ™Å›lÄ… jaÅºÅ„")[0][2] == "Zażółć gęślą jaźń"
