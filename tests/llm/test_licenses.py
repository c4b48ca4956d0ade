import pytest

from memberlens.llm import licenses
from memberlens.llm import license_texts as texts


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.TEMPLATES)


def names(scanner, text):
    return [hit[0] for hit in scanner.scan(text)]


@pytest.mark.parametrize("text,want", [
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License, version 7.", []),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("This work is licensed under the Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial 3.0 International License.", ["CC-BY-NC-3.0"]),
    ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1"]),
    (texts.SOURCE + texts.BINARY + texts.DISCLAIMER, ["BSD-2-Clause"]), (texts.SOURCE + texts.DISCLAIMER, ["BSD-1-Clause"]), (texts.SOURCE, []),
    (texts.GRANT + ". " + texts.WARRANTY, ["MIT-0"]), (texts.GRANT + texts.NOTICE + texts.WARRANTY + texts.ADVERTISING, ["X11"]),
])
def test_siblings_are_told_apart(scanner, text, want):
    assert names(scanner, text) == want


def test_every_template_is_found_as_itself(scanner):
    for name, text in licenses.TEMPLATES:
        assert name in names(scanner, "before it " + text + " after it"), (name, text[:90])
        if len(text) < 3000:
            assert names(scanner, text) == [name], (name, text[:90])


def test_sibling_notices_in_one_text(scanner):
    notices = {n: t for n, t in texts.gnu_notices() if len(t) > 100}
    text = notices["LGPL-2.1"] + "\n" + notices["GPL-3.0"]
    assert names(scanner, text) == ["GPL-3.0", "LGPL-2.1"]


def test_edited_copies_beside_the_rarest_word(scanner):
    """The rarest word of the template stands once, far from two edited copies."""
    mit = texts.GRANT + texts.NOTICE + texts.WARRANTY
    edited = mit.replace("sublicense", "relicense").replace("free of charge", "gratis")
    noise = "the software and a copy of this notice shall be used or sold to any person " * 300
    text = noise + edited + "\n" + edited + noise + "sublicense " + noise
    assert names(scanner, text) == ["MIT"] and len(text) > 60_000
    (_, matched, _, start, end), = scanner.scan(text)
    assert matched == len(licenses.words_of(mit)) - 4 and len(noise) <= start < end <= len(noise + edited) * 2


@pytest.mark.parametrize("seed", range(12))
def test_edited_copies_among_others_are_found(scanner, seed):
    """Words are replaced, left out or put in at random; what stays is above the coverage."""
    import random

    rng = random.Random(seed)
    mit = licenses.words_of(texts.GRANT + texts.NOTICE + texts.WARRANTY)
    mit = [w.decode() for w in mit]

    def edited():
        out = []
        for w in mit:
            x = rng.random()
            out += [w, "new"] if x < 0.07 else [] if x < 0.12 else ["other"] if x < 0.15 else [w]
        return out

    noise = [rng.choice(mit) for _ in range(3000)]
    text = " ".join(noise + edited() + edited() + edited() + noise)
    assert "MIT" in names(scanner, text)

