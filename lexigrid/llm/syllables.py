"""Vietnamese syllables without accents, and slips in them."""

from __future__ import annotations

import re

# The parts of a Vietnamese syllable, without accents; k, gh and ngh stand before e, i, y, and c, g and ng do not.
ONSETS = r"(?:k|gh|ngh)(?=[eiy])|(?:c|g|ng)(?![eiyh])|gi|qu|kh|ch|nh|ph|th|tr|b|d|h|l|m|n|r|s|t|v|x|"
RHYMES = (
    "a ac ach ai am an ang anh ao ap at au ay e ec ech em en eng enh eo ep et eu i ia ich iec iem ien ieng iep iet ieu im in inh ip it iu o oa oac oach "
    "oai oam oan oang oanh oao oap oat oay oc oe oen oeo oet oi om on ong op ot u ua uan uang uat uay uc ue uech uenh ui um un ung uo uoc uoi uom uon "
    "uong uop uot uou up ut uu uy uya uych uyen uyet uyn uynh uyt uyu"
).split()
# Syllables with y alone.
Y_SYLLABLES = "y|yem|yen|yet|yeu|hy|ky|ly|my|sy|ty"
_SYLLABLE = re.compile(rf"(?:{Y_SYLLABLES})|(?:{ONSETS})(?:{'|'.join(sorted(RHYMES, key=len, reverse=True))})")


def valid(t: str) -> bool:
    """If it is a syllable."""
    return _SYLLABLE.fullmatch(t) is not None


def one_edit(a: str, b: str) -> bool:
    """One letter more, less, other or swapped with its neighbour."""
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    s, t = (a, b) if len(a) > len(b) else (b, a)
    return s[i + 1 :] == t[i:]
