"""Words and made-up texts for the tests."""

WORDS = {
    "en": "the of and shed thing over under winter morning letter river stone with from they would could about there".split(),
    "de": "der die und über nicht größe straße winter morgen brief fluss stein mit von sie würde könnte etwa dort schön".split(),
}


def make_text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))
