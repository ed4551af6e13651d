"""Labelled findings for the secret network: made-up secrets of public formats, and what looks like them but is none.

Every call draws new ones; nothing here is, or comes from, a real secret.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
MIXED = UPPER + LOWER + DIGITS

# Words that identifiers, paths and addresses are made of.
WORDS = """account action array async audio author backup batch binary block buffer build button cache client cloud column commit config content context counter
customer daily data default delete detail device directory document domain download editor element engine error event export factory feature field file filter folder
format frame front function gallery global group handler header helper history image import index input install interface item journal kernel language latest layer layout
level library license limit linux list local locale logger machine main manager market master matrix member message method metric mobile model module month network node
number object offset option order output package page parser partner path pattern payment photo player plugin policy portal power preview price process product profile
project public query queue random range reader record region release remote report request resource response result review router sample schema screen script search section
select sender server service session setting shadow shared signal simple site source stack start state static status storage stream string style summary support switch
system table target task template theme thread time title track transfer update upload user utility value vector vendor version video view visitor volume week widget window
worker writer year zone""".split()
# What stands before a secret, and before other long tokens.
SECRET_BEFORE = """the key pair is |credentials: |login with |api credential |my pass is |access |auth |bearer |Authorization: Bearer |private key |use this to sign in: |pwd |key |signing key
|client credential |deploy key |export KEY=|AWS |the new one is |session |connect with |license key """.replace("\n", "").split("|")
OTHER_BEFORE = "see |file |in |the function |call |version |commit |visit |from |mail |at |order |reference |page |image |download |on |class |module |path |id |by ".split("|")


def _of(r: np.random.Generator, alphabet: str, least: int, most: int | None = None) -> str:
    n = least if most is None else int(r.integers(least, most + 1))
    return "".join(alphabet[i] for i in r.integers(0, len(alphabet), n))


def _word(r: np.random.Generator) -> str:
    return WORDS[int(r.integers(0, len(WORDS)))]


def _words(r: np.random.Generator, least: int, most: int) -> list[str]:
    return [_word(r) for _ in range(int(r.integers(least, most + 1)))]


def _pick(r: np.random.Generator, *xs):
    return xs[int(r.integers(0, len(xs)))]


def _password(r: np.random.Generator) -> str:
    body = list(_of(r, LOWER, 3, 5) + _of(r, UPPER, 2, 3) + _of(r, DIGITS, 2, 3) + _of(r, "_=+-", 1, 2))
    return "".join(body[i] for i in r.permutation(len(body)))


#: Formats of secrets: a long token each.
SECRETS: dict[str, Callable[[np.random.Generator], str]] = {
    "base64 of 40": lambda r: _of(r, MIXED + "+/", 40),
    "base64, any length": lambda r: _of(r, MIXED + "+/", 24, 88) + _pick(r, "", "=", "=="),
    "base64 for URLs": lambda r: _of(r, MIXED + "-_", 22, 64),
    "letters and digits": lambda r: _of(r, MIXED, 20, 64),
    "lower letters and digits": lambda r: _of(r, LOWER + DIGITS, 24, 50),
    "upper hex": lambda r: _of(r, DIGITS + "ABCDEF", 24, 64),
    "ghp_": lambda r: _pick(r, "ghp_", "gho_", "ghs_", "ghu_", "glpat-", "npm_", "hf_") + _of(r, MIXED, 20, 36),
    "github_pat_": lambda r: "github_pat_" + _of(r, MIXED, 22) + "_" + _of(r, MIXED, 59),
    "sk_live_": lambda r: _pick(r, "sk_live_", "rk_live_", "pk_live_", "sk_test_", "whsec_", "sk-") + _of(r, MIXED, 24, 48),
    "xoxb-": lambda r: _pick(r, "xoxb-", "xoxp-", "xoxa-") + f"{_of(r, DIGITS, 10, 13)}-{_of(r, DIGITS, 10, 13)}-{_of(r, MIXED, 24)}",
    "JWT": lambda r: f"eyJ{_of(r, MIXED, 20, 36)}.eyJ{_of(r, MIXED, 30, 90)}.{_of(r, MIXED + '-_', 43)}",
    "AIza": lambda r: "AIza" + _of(r, MIXED + "-_", 35),
    "SG.": lambda r: "SG." + _of(r, MIXED + "-_", 22) + "." + _of(r, MIXED + "-_", 43),
    "grouped upper": lambda r: "-".join(_of(r, UPPER + DIGITS, 5) for _ in range(int(r.integers(4, 6)))),
    "password": _password,
}
#: Formats of long tokens that are no secrets.
OTHERS: dict[str, Callable[[np.random.Generator], str]] = {
    "camelCase": lambda r: "".join(w if i == 0 else w.title() for i, w in enumerate(_words(r, 2, 5))) + _pick(r, "", "", _of(r, DIGITS, 1, 2)),
    "CamelCase": lambda r: "".join(w.title() for w in _words(r, 2, 4)) + _pick(r, "", "", "2", _of(r, DIGITS, 1, 2)),
    "snake_case": lambda r: "_".join(_words(r, 2, 5)) + _pick(r, "", "_" + _of(r, DIGITS, 1, 4)),
    "CONSTANT_CASE": lambda r: "_".join(_words(r, 2, 5)).upper() + _pick(r, "", "_" + _of(r, DIGITS, 1, 3)),
    "kebab-case": lambda r: "-".join(_words(r, 2, 6)) + "-" + _of(r, DIGITS, 1, 5),
    "dotted path": lambda r: ".".join(_words(r, 2, 5)) + _pick(r, "", "." + _word(r).title(), _of(r, DIGITS, 1, 2)),
    "file path": lambda r: "/" + "/".join(_words(r, 2, 5)) + _pick(r, "", _of(r, DIGITS, 1, 3)) + _pick(r, ".py", ".txt", ".html", ".jpg", ".js", "/"),
    "URL": lambda r: f"//{_pick(r, 'www.', '', 'api.', 'blog.')}{_word(r)}{_pick(r, '', _of(r, DIGITS, 1, 2))}.{_pick(r, 'com', 'org', 'net', 'example.com', 'de')}/" + "/".join(_words(r, 1, 3)) + _pick(r, "", "/" + _of(r, DIGITS, 1, 8)),
    "mail": lambda r: f"{_word(r)}.{_of(r, DIGITS, 1, 3)}",
    "host": lambda r: f"{_pick(r, 'mail', 'www', 'node', 'srv')}{_of(r, DIGITS, 1, 2)}.{_word(r)}.{_pick(r, 'com', 'org', 'net')}",
    "hash in a file name": lambda r: f"{_word(r)}.{_of(r, HEX, 6, 12)}.{_pick(r, 'js', 'css', 'min.js', 'png')}",
    "short commit": lambda r: _of(r, HEX, 8, 12),
    "UUID": lambda r: "-".join(_of(r, HEX, n) for n in (8, 4, 4, 4, 12)),
    "number": lambda r: _of(r, DIGITS, 8, 19) + _pick(r, "", "", "px", "kg", "th"),
    "date": lambda r: f"{_of(r, '12', 1)}{_of(r, DIGITS, 3)}-{_of(r, '01', 1)}{_of(r, DIGITS, 1)}-{_of(r, '012', 1)}{_of(r, DIGITS, 1)}" + _pick(r, "", f"T{_of(r, '01', 1)}{_of(r, DIGITS, 1)}"),
    "version": lambda r: f"{_word(r)}-{_of(r, DIGITS, 1)}.{_of(r, DIGITS, 1, 2)}.{_of(r, DIGITS, 1, 2)}" + _pick(r, "", "-beta1", ".tar.gz", "-x86_64"),
    "ISBN or code": lambda r: _pick(r, "ISBN-", "RFC", "ISO-", "DIN-EN-", "CVE-", "PMC", "doi.org/10.") + _of(r, DIGITS, 4, 9) + _pick(r, "", "-" + _of(r, DIGITS, 1, 4)),
    "numbered word": lambda r: _word(r) + _word(r) + _of(r, DIGITS, 1, 4),
    "long word": lambda r: "".join(_words(r, 4, 6)),
}


def draw(r: np.random.Generator, each: int, snippets: list[str], secret: bool, only: list[str] | None = None) -> list[tuple[str, str, int, int]]:
    """(format, text, start, end): `each` findings of every format, in surroundings of the corpus's own wording, of telling words, or of none.

    snippets: pieces of the corpus's texts to stand about them; any may be empty.
    """
    out = []
    before = SECRET_BEFORE if secret else OTHER_BEFORE
    for name, make in (SECRETS if secret else OTHERS).items():
        for _ in range(each if only is None or name in only else 0):
            token, way = make(r), r.random()
            left = snippets[int(r.integers(0, len(snippets)))] if snippets else " ".join(_words(r, 4, 8))
            right = snippets[int(r.integers(0, len(snippets)))] if snippets else " ".join(_words(r, 4, 8))
            left = left.rstrip() + _pick(r, " ", " ", "\n", ". ", ": ")
            if way < 0.35:
                left += _pick(r, *before) if r.random() < 0.9 else _pick(r, *SECRET_BEFORE)
            elif way < 0.5:
                left, right = "", ""
            elif way < 0.6:
                left, right = left + _pick(r, '"', "'", "(", "="), _pick(r, '"', "'", ")") + right
            right = _pick(r, " ", " ", "\n", ", ", ". ") + right.lstrip() if right else ""
            out.append((name, left + token + right, len(left), len(left) + len(token)))
    return out
