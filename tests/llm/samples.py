"""Small documents with the awkward cases."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns of other meaning whose names the operators use within.
CLASHING = ("rep component n tokens _tokens edited words at spans trigram rules kept a b shingle lang_pred score "
            "anchor place _row item_id fingerprint base added").split()


def sentence(rng, n):
    return " ".join(rng.choice("the of and in mint area word lake tree blue code path river stone".split())
                    + str(rng.randrange(40)) for _ in range(n))


def made(seed=5, n=40):
    """Documents with copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(seed)
    passage = sentence(rng, 30)
    rows = [(i, sentence(rng, rng.randrange(1, 120)), "xy"[i % 2], f"s{i % 3}") for i in range(n)]
    rows += [(100 + i, rows[i][1], "x", "s0") for i in range(4)]
    for i in range(6):
        words = rows[2 * i][1].split()
        words[len(words) // 2] = "changed"
        rows.append((200 + i, " ".join(words), None, None))
    rows += [(300 + i, sentence(rng, 9) + " " + passage + "\n" + sentence(rng, 7), "y", "s1") for i in range(5)]
    rows += [(400, None, "x", "s0"), (401, "", "x", "s0"), (402, " \n\t", None, "s2"), (403, "é", "y", None),
             (404, sentence(rng, 4000), "y", "s1"), (405, "w" * 3000, "x", "s1"), (406, "a b", "x", "s2"),
             (407, "A B", "x", "s2"), (408, "same " * 60, "x", "s2"), (409, "same " * 45, "y", "s0"),
             (None, passage, "x", "s0"), (300, sentence(rng, 12), "x", "s0"),
             (7, rows[7][1], "y", "s1")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
