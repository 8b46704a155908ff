from notegrove.sources import formats, markdown
from notegrove.sources.formats import extract


def squeeze(text):
    return " ".join(text.split())


def test_frontmatter_and_tags():
    d = extract("markdown", "---\ntitle: X\ntags: [A, b]\nlist:\n- one\n- 'two'\n---\n#c text #12 (#d)\n")
    assert d.tags == ["a", "b", "c", "d"]
    assert d.properties == {"title": "x", "tags": "a, b", "list": "one two"}
    assert d.frontmatter == (0, 49) and len(d.text) == 67


def test_unclosed_frontmatter_is_text():
    assert extract("markdown", "---\na: b\n").frontmatter is None


def test_inline_markup_is_blanked():
    raw = "**b** _i_ `co_de` [text](http://u) [[Page|alias]] ![img](x) <b>t</b> a\\*b [^1] ~~s~~ <!-- no -->"
    d = extract("markdown", raw)
    assert len(d.text) == len(raw)
    assert squeeze(d.text) == "b i co_de text alias img t a *b s"


def test_headings_breaks_and_tasks():
    raw = "# One ##\n\nTwo\n===\n- [ ] t\n```\n- [ ] x\n\n```\n> \n"
    n = markdown.scan(raw)
    assert [(h[0], raw[h[3] : h[4]]) for h in n.headings] == [(1, "One"), (1, "Two")]
    assert n.breaks == [9, 38, 43] and n.open_task
    assert not markdown.scan("```\n- [ ] x\n```").open_task and not markdown.scan("- [x] y").open_task


def test_lines_that_are_only_markup():
    assert extract("markdown", "---\n***\n|a|\n|-|\n[x]: http://y\n[x]: y z").text.split() == ["a", "x", ":", "y", "z"]


def test_offsets_of_decomposed_text():
    d = extract("markdown", "e\u0301a #Ta\u0308g")
    assert d.text == "ea  tag" and d.offset_map == [0, 2, 3, 4, 5, 6, 8, 9] and d.tags == ["tag"]


def test_canvas_and_base():
    c = '{"nodes":[{"id":"n","text":"A \\"q\\" \\u00e4b","color":"1"},{"label":"G"},{"file":"d/e.md"}],"x":{"url":"u'
    d = extract("canvas", c)
    assert squeeze(d.text) == "a q b g d/e.md u"
    assert all(d.text[i] == c[o].lower() or d.text[i] == " " for i, o in enumerate(d.offset_map[:-1]))
    d = extract("base", " a: 1\n\n  - b \r\n")
    assert d.text == "a: 1 - b" and d.breaks == [4]


def test_barriers_stop_at_blocks():
    assert extract("markdown", "a\n\nb").with_barriers() == f"a {formats.BARRIER}b"
    assert extract("markdown", "# h\nt").with_barriers().count(formats.BARRIER) == 2
