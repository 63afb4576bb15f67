import pytest

from folioforge.operators import markers as M


@pytest.mark.parametrize("rule, text, want", [
    (M.clean, "a [[STRIKE: b]] c [[REPLACE: x -> y]] [[INSERT: z]]", "a  c y z"),
    (M.clean, "[[QUESTION_ROW: 1. a [[STRIKE: q]]b || none || 3M]]", "[[QUESTION_ROW: 1. a b none || 3M]]"),
    (M.clean, "Answer: secret\nnext", "_" * 20 + "\nnext"),
    (M.clean, "open [[STRIKE: x", "open [[STRIKE: x"),
    (M.clean, "[[ 7 ]]", "[[BOXED: 7]]"),
    (lambda t: M.canonical_row("QUESTION_ROW", t), "1. a || none", "1. a"),
    (lambda t: M.canonical_row("MATCH_ROW", t), "a ____ || none", "[[MATCH_ROW: a ____ || ]]"),
    (lambda t: M.canonical_row("SECTION_ROW", t), "I. Do || 5x2=10", "[[SECTION_ROW: I. Do || 5x2=10]]"),
    (M.pipe_tables, "| a | b |\n|---|---|\n| 1 | 2 |\nx", "[[TABLE_ROW: a || b]]\n[[TABLE_ROW: 1 || 2]]\nx"),
    (M.pipe_tables, "| | | |\n| | | |", "[[GRID: 3x2]]"),
    (M.native_rows, "Class: 5 || Subject: Maths\n1. a ____ || 2. b ( )\nClass: 5 || Subject: x", "[[TABLE_ROW: Class: 5 || Subject: Maths]]\n[[MATCH_ROW: 1. a ____ || 2. b ( )]]\nClass: 5 || Subject: x"),
    (M.writing_boxes, "Write the letters A to L", "Write the letters A to L\n[[GRID: 10x1]]\n[[GRID: 2x1]]"),
    (M.writing_boxes, "Fill the missing letters A to L", "Fill the missing letters A to L"),
    (M.maths_rows, "1 | 2 | 3 | 4 | 5\nWrite numbers from 1 to 20", "[[GRID_ROW: 1 || 2 || 3 || 4 || 5]]\nWrite numbers from 1 to 20\n[[GRID: 10x2]]"),
    (M.closed_lines, "[TABLE_ROW: a || \n[[GRID: 2x2]]", "[[TABLE_ROW: a]]\n[[GRID: 2x2]]"),
    (M.pipe_tables, "वर्णमाला\n| क | ख | ग | घ |\n| a | b |", "वर्णमाला\n[[GRID_ROW: क || ख || ग || घ]]\n| a | b |"),
    (M.pipe_tables, "| | |\n| | |\n|---|---|\n| 1 | 2 |\n| | | |", "[[GRID: 2x2]]\n|---|---|\n| 1 | 2 |\n[[GRID: 3x1]]"),
    (M.native_rows, "[[TABLE_ROW: Name : || Roll no :]]\nClass: 5 || Time: 1 || Marks", "[[TABLE_ROW: Name : || Roll no :]]\n\n[[TABLE_ROW: Class: 5 || Time: 1 || Marks]]"),
    (M.closed_lines, "[[COUNT_OBJECTS: Stars , 5|3|Box|1.5,2,3,4.2]] = [[ ]] [[]]", "[[COUNT_OBJECTS: star,5|3.|box|1,2,4,5]] [[CHECKBOX]]"),
    (M.closed_lines, "[[SOURCE_FIGURE_ROW: [[SOURCE_FIGURE: a]] || [[SOURCE_FIGURE: b]]]]", "[[SOURCE_FIGURE_ROW: a || b]]"),
    (M.maths_rows, "I. Tens and ones\n1 || 2 || 3\nII. x\n1 || 2 || 3", "I. Tens and ones\n[[TABLE_ROW: 1 || 2 || 3]]\nII. x\n1 || 2 || 3"),
    (M.without_repeated_prelude, "Answer the following\n\n[[SECTION_ROW: II. Answer the following || 5M]]", "\n\n[[SECTION_ROW: II. Answer the following || 5M]]"),
    (M.without_repeated_prelude, "Read it\n[[SECTION_ROW: II. Read it || 5M]]\nsame line\nsame line", "Read it\n[[SECTION_ROW: II. Read it || 5M]]\nsame line\nsame line"),
    (M.recognised_markup, "<table><tr><td>a</td><th>b</th></tr></table>", "[[TABLE_ROW: a || b]]"),
    (M.recognised_markup, "<table><tr><td>a</td>junk</tr></table>", "<table><tr><td>a</td>junk</tr></table>"),
    (M.grid_cells, "\n".join("abcdefgh") + "\nxx", "[[GRID_ROW: a || b || c || d || e || f || g || h]]\nxx"),
    (M.plain, "[[FIGURE: 1,1,2,2|cat]] [[CHECKBOX]] [[UNDERLINE: u]] [[OPTION_ROW: a || b]]", "cat [ ] u a [ ]   b [ ]"),
    (M.plain, "[[GRID: 3x2]]", "□ □ □\n□ □ □"),
    (M.branches, "[[BRANCH_ROOT: R]]\n[[BRANCH_ITEM: a || x]]\n[[BRANCH_ITEM: b || ]]\n[[BRANCH_END]]\nz", "     ↗ a ───────── x\n○ R → b\nz"),
])
def test_rules(rule, text, want):
    assert rule(text) == want


@pytest.mark.parametrize("text", ["", "a\nb", "[[SECTION_ROW: I. Do || 3M]]\n1. x ____ || 2. y ____", "| a | b |\n|---|---|\n| 1 | 2 |", "Write letters A to C\n", "GRID: 3x2"])
def test_normalising_twice_changes_nothing(text):
    once = M.normalise(text)
    assert M.normalise(once) == once


def test_headers_of_continuation_pages_go():
    head = "[[TABLE_ROW: Name: || Class: 5 || Roll no]]"
    text = f"{head}\nI. Read\n1. a\n{head}\nII. Write"
    assert M.without_repeated_headers(text) == f"{head}\nI. Read\n1. a\nII. Write"
    assert M.without_repeated_headers(f"{head}\nI. Read\n1. a\n{head}\nI. Write").count("Roll no") == 2


def test_protection_is_undone():
    text = "On 12/03/1999, १२ items; 3.5 kg।\nEnd 2001"
    hidden, kept = M.protect(text)
    assert not any(c.isdigit() for c in hidden.replace("\ue010", "").split("\ue011")[0][:2]) and M.restore(hidden, kept) == text


def test_runs():
    assert M.styled_runs("a [[UNDERLINE: b]] c") == [("", "a "), ("underline", "b"), ("", " c")]


def test_crowded_headers_that_are_read_again_go():
    crowded = "[[TABLE_ROW: Name: Class: 5 Roll no Marks: 50 Date: 1]]"
    clean = "[[TABLE_ROW: Name: || Class: 5]]\n[[TABLE_ROW: Roll no || Marks: 50]]"
    assert M.without_repeated_headers(f"{crowded}\n\n{clean}\nI. Read") == f"\n{clean}\nI. Read"
    assert M.without_repeated_headers(f"{crowded}\nI. Read") == f"{crowded}\nI. Read"


def test_maths_figures():
    assert M.maths_figure("COUNT_OBJECTS", "star,5|3.|box|1,2,3,4") == {"kind": "COUNT_OBJECTS", "label": "3.", "answer": True, "region": [1, 2, 3, 4], "object": "star", "count": 5}
    assert M.maths_figure("ABACUS", "T=3,O=4")["rods"] == {"T": 3, "O": 4}
    assert [M.maths_figure(k, b) for k, b in (("COUNT_OBJECTS", "star,31"), ("COUNT_OBJECTS", "cow,3"), ("ABACUS", "T=3,T=4"), ("ABACUS", "T=3|x"), ("ABACUS", "T=3|1|box|0,0,1001,1"))] == [None] * 5
