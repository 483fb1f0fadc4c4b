"""Keys of the Latin and Cyrillic layouts: which characters share a key, which keys lie side by side."""

from __future__ import annotations

import numpy as np

#: The code of each key, and the characters that it types in either layout.
TYPED: dict[int, str] = {
    48: "0", 49: "1!", 50: "2@\"", 51: "3#№", 52: "4$;", 53: "5%", 54: "6^:", 55: "7&?", 56: "8*", 57: "9(", 58: ")",
    65: "AФ", 66: "BИ", 67: "CС", 68: "DВ", 69: "EУ", 70: "FА", 71: "GП", 72: "HР", 73: "IШ", 74: "JО", 75: "KЛ", 76: "LД", 77: "MЬ",
    78: "NТ", 79: "OЩ", 80: "PЗ", 81: "QЙ", 82: "RК", 83: "SЫ", 84: "TЕ", 85: "UГ", 86: "VМ", 87: "WЦ", 88: "XЧ", 89: "YН>", 90: "ZЯ",
    124: "|", 186: "Ж", 187: "=+", 188: "<Б", 189: "-_", 190: "Ю", 191: ",./", 192: "`~Ё", 219: "[{Х", 221: "]}Ъ", 222: "'Э", 8211: "–",
}

#: A key's neighbours. Three of the steps lead one way only (192 to 49, 186 to 188, 190 to 186).
BESIDE: dict[int, frozenset[int]] = {
    key: frozenset(around)
    for key, around in {
        48: (57, 79, 80, 189), 49: (50, 81), 50: (49, 51, 81, 87), 51: (50, 52, 69, 87), 52: (51, 53, 69, 82), 53: (52, 54, 82, 84),
        54: (53, 55, 84, 89), 55: (54, 56, 85, 89), 56: (55, 57, 73, 85), 57: (48, 56, 73, 79), 65: (81, 83, 87, 90), 66: (71, 72, 78, 86),
        67: (68, 70, 86, 88), 68: (67, 69, 70, 82, 83, 88), 69: (51, 52, 68, 82, 83, 87), 70: (67, 68, 71, 82, 84, 86), 71: (66, 70, 72, 84, 86, 89),
        72: (66, 71, 74, 78, 85, 89), 73: (56, 57, 74, 75, 79, 85), 74: (72, 73, 75, 77, 78, 85), 75: (73, 74, 76, 77, 79, 188),
        76: (75, 79, 80, 186, 188, 190), 77: (74, 75, 78, 188), 78: (66, 72, 74, 77), 79: (48, 57, 73, 75, 76, 80), 80: (48, 76, 79, 186, 189, 219),
        81: (49, 50, 65, 87), 82: (52, 53, 68, 69, 70, 84), 83: (65, 68, 69, 87, 88, 90), 84: (53, 54, 70, 71, 82, 89), 85: (55, 56, 72, 73, 74, 89),
        86: (66, 67, 70, 71), 87: (50, 51, 65, 69, 81, 83), 88: (67, 68, 83, 90), 89: (54, 55, 71, 72, 84, 85), 90: (65, 83, 88),
        186: (76, 80, 188, 191, 219, 222), 187: (189, 219, 221), 188: (75, 76, 77, 190), 189: (48, 80, 187, 219), 190: (76, 186, 188, 191),
        191: (186, 190, 222), 192: (49,), 219: (80, 186, 187, 189, 221, 222), 221: (187, 219, 222), 222: (186, 191, 219, 221),
    }.items()
}

#: Character to key code: upper-case letters, digits and signs.
KEY_OF: dict[str, int] = {c: key for key, chars in TYPED.items() for c in chars}


def cost(a: str, b: str) -> int:
    """Of typing a for b: 0 for the same character or key, 1 for a neighbouring key, else 2."""
    if a == b:
        return 0
    x, y = KEY_OF.get(a), KEY_OF.get(b)
    if x is None or y is None:
        return 2
    return 0 if x == y else 1 if y in BESIDE.get(x, ()) else 2


#: Characters by number: those with a key from 1, all others 0; and the costs between them.
CHARS = sorted(KEY_OF)
NUMBER = {c: k + 1 for k, c in enumerate(CHARS)}
COSTS = np.full((len(CHARS) + 1, len(CHARS) + 1), 2, dtype=np.int16)
for _a in CHARS:
    for _b in CHARS:
        COSTS[NUMBER[_a], NUMBER[_b]] = cost(_a, _b)
CODES = np.array([-1] + [KEY_OF[c] for c in CHARS], dtype=np.int32)
