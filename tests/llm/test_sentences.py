import random

import numpy as np
import pytest

from reelgrain.llm import sentences as s


def split(text, kind="note"):
    return [text[a:b] for a, b in s.sentences_of(text, kind)]


@pytest.mark.parametrize(
    "want",
    [
        ["R. T. and J. M. said it (see Fig. 12.) at 11 a.m. on the set.", "No. 20 of the list was lost.", "No.", "It was 1.54."],
        ["reader.py wrote 19 rows.", "run.json is fine.", "iPad view 2 stopped at 6 p.m.", "The U.K. camera, i.e. the old one, did not."],
        ['"Which of them touched it?" asked the reviewer.', 'They asked, "Was it set aside?"', "The share fell from 2.74 to 1.23... but it held."],
        ["“Keep the view.”", "Fig. 7 shows it.", "We kept A, B, etc.", "It (it missed the mask! twice, in fact) failed?!", "Never run it!"],
        ["Dr. K. Moor schrieb am 9. Mai, vgl. Abb. 6.", "Die 9. Prüfung um 0:41 Uhr betraf ihn.", "„Es passt. Bitte prüfen.“ stand am Rand.", "Es waren 1,10 m usw.", "D. h. ja."],
        ["« La plaque masque. À revoir. » dit la note de Mme A. Tull.", "C'est fini !", "Pourquoi pas ?", "splat.ply donne 11 lignes (cf. fig. 11)."],
        ["«El robot tapa. Revisar.» dice la nota de EE. UU. sin referencia.", "¡No ejecute run.json!", "¿Por qué no?", "Vea p. ej. la pág. 3."],
    ],
)
def test_spaced_scripts(want):
    assert split(" ".join(want)) == want


@pytest.mark.parametrize(
    "want",
    [
        ["地面掩码……第二次运行中早于评审表。", "记录写道：“新的剪辑早于它。请再看。”随后它停了。", "为什么？", "run.json写出9行。"],
        ["「背景板を見た。もう一度見ること。」と書いてある。", "割合は2.84から0.90へ下がった！", "なぜか？"],
    ],
)
def test_scripts_without_spaces(want):
    assert split("".join(want)) == want


def test_hindi_arabic_thai():
    assert split("डॉ. वेल ने देखा। क्या? पर्ची पर \"यह रुका। फिर देखें।\" और गया।") == ["डॉ. वेल ने देखा।", "क्या?", 'पर्ची पर "यह रुका। फिर देखें।" और गया।']
    assert split("كتب د. فال أن 1.28 كاف. هل هو؟ نعم «هذا. راجعه.» وذاك.") == ["كتب د. فال أن 1.28 كاف.", "هل هو؟", "نعم «هذا. راجعه.» وذاك."]
    assert split("ไฟล์เส้นขอบชนกับ\nหน้ากากพื้น ไฟล์ run.json ระบุ 20 จุด") == ["ไฟล์เส้นขอบชนกับ", "หน้ากากพื้น", "ไฟล์ run.json ระบุ 20 จุด"]


def test_layout():
    text = "﻿## A heading. With two\r\n\r\n- item one. still one\n- item two\n\n1. first\n2. second.\n\nA line\nwraps here. It ends\n\n   \nbefore this  \n"
    assert split(text) == ["A heading. With two", "item one. still one", "item two", "first", "second.", "A line\nwraps here.", "It ends", "before this"]
    assert split("am\n9. Mai war es.") == ["am\n9. Mai war es."]
    assert split("[1:2] No. It is. \n\n - [3:4] x", "job_log") == ["[1:2] No. It is.", "- [3:4] x"]


def test_unclosed_marks_are_ignored():
    assert split('He read "one thing. Then another (no end. Last one.') == ['He read "one thing.', "Then another (no end.", "Last one."]
    assert split('Touched port" without. Next one.') == ['Touched port" without.', "Next one."]


def test_blank_and_case():
    assert split("") == split(" ﻿\n ") == split("- ") == []
    assert split("it was so. we kept it, etc. no. 3 was lost before 6 p.m. it stays.") == ["it was so.", "we kept it, etc.", "no. 3 was lost before 6 p.m.", "it stays."]
    assert split("One.Two? Three") == ["One.", "Two?", "Three"]


def test_functions_compose_like_a_run():
    rng = random.Random(0)
    for _ in range(200):
        symbols = [rng.randrange(s.N_EVENTS) for _ in range(60)]
        flags = s.matched_flags(symbols, 0)
        k = rng.randrange(61)
        keep, put = s.right_function(symbols[k:])
        assert flags[:k] == s.matched_flags(symbols[:k], put)
        f, g = s.left_function(symbols[:k], flags[:k]), s.left_function(symbols[k:], flags[k:])
        whole = s.left_function(symbols, flags)
        assert (g[f] == whole).all()
        state = int(f[0])
        assert s.boundaries(symbols, flags, 0) == s.boundaries(symbols[:k], flags[:k], 0) + [k + i for i in s.boundaries(symbols[k:], flags[k:], state)]


def test_chunks_equal_the_whole(spark):
    rng = random.Random(7)
    parts = ["The view (see Fig. 3. and more", ") ended.", ' "Was it? Yes.', '" said one.', "\n\n- item. x\n", "\n\n", "\n", " “Keep. It.” ", "No. 3 is. ", "a.m. ", "记录：“好。”然后。", "«x. y» z. ", "ไทย ไทย ", "„a. b.“ c. ", "  "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 400))), rng.choice(["note", "job_log", None])) for i in range(40)]
    rows += [(99, None, "note"), (None, "A. B.", "note"), (98, "   ", "note"), (97, "One. Two.", "note"), (97, "One. Two.", "note")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, doc_type string, start_char int, row int")
    got = sorted(tuple(r) for r in s.sentences(df, chunk=1024).collect())
    assert got == sorted((i, a, b) for i, t, k in rows if i is not None and t is not None for a, b in s.sentences_of(t, k))
    assert s.sentences(df.limit(0)).count() == 0
    assert len(np.unique(s.MOVE)) <= s.N_STATES


def in_chunks(text, kind, chunks):
    lower, out = text == text.lower(), []
    for start, stop, marked in chunks:
        base, piece = s.window(text, start, stop)
        last = stop == len(text)
        out += [(e, base + a, base + b) for e, a, b in s.events(piece, kind == s.LINES, lower, start - base, len(piece) if last else stop - base, marked)]
    return out


LONG_BLANK = "\n" * 300 + " " * 700 + "\n"
PARTS = ["... ", "...... ", "?!... ", ".” ", '." ', ".\u00a0» ", "\n\n\n", " \r\n \n- ", "……", "。」』", LONG_BLANK, "\n1. ", "\n\n12. ", "\ufeff", "ca. 3 m ", "am" + " " * 90 + "9. Mai ", "____" * 30 + "Dr. K ",
         "run.json ", "only, ", "he said (so. it is) ", "“It was. So” ", "no. 4 ", "word's ", "ไทย ไทย ", "只剩 2. 97。", "x" * 300 + ".py ", "etc. and ", ":\n2. item", "- ", "## ", "A. ", "Ok.Prof. O. ", "u.s. "]


@pytest.mark.parametrize("seed", range(30))
def test_any_border_changes_nothing(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(2, 25)))
    borders = [m.start() for m in s._BORDER.finditer(text)]
    for kind in ("note", "job_log"):
        whole = s.events(text, kind == s.LINES, text == text.lower())
        for size in (1, 7, 64, 900):
            assert in_chunks(text, kind, s.cut(text, size)) == whole
        finest = {start: marked for start, _, marked in s.cut(text, 1)}
        for border in rng.sample(borders, min(8, len(borders))):  # one border alone
            marked, first = finest[border], (0, border, finest[0])
            assert in_chunks(text, kind, [first, (border, len(text), marked)]) == whole, (border, text[border - 5 : border + 5])


def test_borders_lie_between_a_letter_and_no_word():
    for text in ("a" * 100, "a.b" * 50, "1 2 3 " * 30, "。" * 80, " " * 90, ""):
        assert s.cut(text, 10) == [(0, len(text), False)]
    text = "word, " * 5000
    cuts = s.cut(text, 100)
    assert [a for a, _, _ in cuts[1:]] == [b for _, b, _ in cuts[:-1]] and cuts[-1][1] == len(text)
    assert all(100 <= b - a < 110 for a, b, _ in cuts[:-1])


def test_marks_at_the_start_and_without_a_space():
    assert split("\ufeffDr. K. Moor: es passt. Ja.") == ["Dr. K. Moor: es passt.", "Ja."]
    assert split("\ufeffNo. 13 of them was lost.No. 14 was not?!Fig. 7 shows it.") == ["No. 13 of them was lost.", "No. 14 was not?!", "Fig. 7 shows it."]
    assert split("The U.K. camera ran, i.e. the old one.Prof. O. Lind says so.") == ["The U.K. camera ran, i.e. the old one.", "Prof. O. Lind says so."]
    assert split("只剩 2. 97。共 3 . 1帧。") == ["只剩 2. 97。", "共 3 . 1帧。"]
    assert split("A line\n\n1. item") == ["A line", "item"]


def test_chunked_ellipsis_equals_the_whole(spark):
    rows = [(i, "a" * (1000 + i) + " is 1.23... but it held. Then on." + " More of it." * 20, "note") for i in range(40)]
    got = s.sentences(spark.createDataFrame(rows, "doc_id long, text string, doc_type string"), chunk=1024).collect()
    assert sorted(map(tuple, got)) == sorted((i, a, b) for i, t, k in rows for a, b in s.sentences_of(t, k))
