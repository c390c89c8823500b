import time

import pytest

from shardframe.llm import html_text as H

STOP = frozenset("the of and to in is that it was for on are as with".split())
LONG = "The history of the town is that of the river and of the people who came to it for work in the mills."
OTHER = "It was in the spring that the first of them came to the valley and it is said that they were on foot."


def text(page):
    return H.main_text(page, STOP)


def test_article_without_what_surrounds_it():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";x(1<2);</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy the best of the {LONG}</div>
    <article><h1>Head &amp; line</h1><p>{LONG}</p><p>Short.</p><ul class="share-buttons"><li>Tweet</li></ul><p>{OTHER}</p>
    <aside>{LONG}</aside><form><label>Mail</label><input></form><section id="comments"><p>{OTHER}</p></section></article>
    <div class="cookie-notice"><p>{LONG}</p></div><footer>&copy; 2024 {LONG}</footer></body></html>"""
    assert text(page) == f"Head & line {LONG} Short. {OTHER}"


def test_references_white_space_and_inline_markup():
    page = "<article><p>a&nbsp;b &lt;i&gt; x<b>y</b>z\n\t w<br>next<!-- no --> &eacute;&#233;&#xe9;</p>\x0b<p> end </p></article>"
    assert text(page) == "a\xa0b <i> xyz w next ééé end"


def test_unclosed_elements():
    assert text("<article><h1>One</h1><p><b>two<br><p>three<ul><li>four<li>five</ul>") == "One two three four five"
    assert text("<article><p>seen</p><script>never closed <p>no</p>") == "seen"
    assert text("<article><p>seen</p><!-- never closed <p>no</p>") == "seen"
    assert text("<nav><p>menu<article>in it</article></nav><article>kept</article>") == "kept"


def test_pages_without_article_use_density():
    page = f"<div><a href=x>{LONG}</a></div><p>{LONG}</p><p>Short one.</p><p>{OTHER}</p><p>Tiny</p><div>{'Xyz '*40}</div>"
    assert text(page) == f"{LONG} Short one. {OTHER}"


def test_open_blocks_take_their_neighbours_label():
    make = lambda labels, main: [H.Block("x", 0, main, label=k) for k in labels]
    assert H.second_pass(make([1, 0, 1, 0, -1, 0, 0, -1], 0)) == [True, True, True, False, False, False, False, False]
    assert H.second_pass(make([1, 0, 1, 0, -1, 0, 0, -1, 0], 1)) == [True, True, True, True, False, False, False, False, True]
    assert H.second_pass(make([0, 0], 1)) == [True, True] and H.second_pass(make([0, 0], 0)) == [False, False]


def test_hidden_and_role():
    page = f'<main><p>{LONG}</p><p hidden>no</p><div role="navigation">no</div><p style="display: none">no</p><p class="badge header">yes</p></main>'
    assert text(page) == f"{LONG} yes"


@pytest.mark.parametrize("page", ["", "plain", "<", "<a '", "<p", "</p></div>", "<article>", "&amp", "<p>" * 2000, "<a href='x" * 300, "<!--", "<script"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(text(page), str)


@pytest.mark.parametrize("part", ["<a '>x", "<script", "<!--x-->", "<p class=\"a>", "<div><p>", "</p>", "&lt;", "<title>x</title>", "<a href=x>y"])
def test_time_follows_the_length(part):
    began = time.perf_counter()
    text(part * 40_000)
    assert time.perf_counter() - began < 20


def test_query_rows(spark, rows):
    body = f"<article><p>{LONG}</p></article>"
    data = [(1, "u", body, "x"), (1, "u", body, "x"), (None, None, None, None), (2, "v", "", "x"), (3, "w", f"<article>{'the of ' * 40000}</article>", "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    out = H.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {(r["page_id"], r["n_chars"]) for r in out.collect()}
    assert got == {(1, len(LONG)), (None, 0), (2, 0), (3, 40000 * 7 - 1)} and out.count() == 5
    assert H.extract(pages.limit(0)).count() == 0


def test_stop_words_are_those_of_many_pages(spark):
    pages = spark.createDataFrame([(k, f"<article>the of word{k}</article>") for k in range(60)], "page_id long, html string")
    assert H.stop_words(pages) == {"the", "of"}


def test_stop_words_do_not_depend_on_how_the_table_is_cut(spark, monkeypatch):
    data = [(k, f"<article>the of {'often' if k % 15 == 0 else 'other'} word{k}</article>") for k in range(60)]
    whole = spark.createDataFrame(data, "page_id long, html string").coalesce(1)
    want = {"the", "of", "often", "other"}
    assert H.stop_words(whole) == want
    assert H.stop_words(whole.repartition(60, "page_id")) == want
    assert H.stop_words(spark.createDataFrame(spark.sparkContext.parallelize(data, 60), "page_id long, html string")) == want
    monkeypatch.setattr(H.textbytes, "SLICE_BYTES", 1)
    monkeypatch.setattr(H, "HELD_WORDS", 3)
    assert H.stop_words(whole) == want


GERMAN = "Es war im Jahr der Flut und die Leute der Stadt sind mit dem Boot auf den Berg, den sie von der Burg kannten."


def test_every_language_has_its_stop_words(spark):
    data = [(k, "u", f'<html lang="en-GB"><p>{LONG} x{k}</p></html>') for k in range(1300)]
    data += [(2000 + k, "u", f"<html class=a lang='de'><p>{GERMAN} y{k}</p><div>{'Xyz ' * 40}</div></html>") for k in range(60)]
    data += [(3000, "u", f"<p>{GERMAN}</p><div>{'Xyz ' * 40}</div>"), (3001, "u", f"<p>{LONG}</p><div>{'Xyz ' * 40}</div>")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(2)
    lists = H.stop_lists(pages)
    assert set(lists) == {"/latin", "en/latin", "de/latin"} and "der" in lists["de/latin"] and "der" not in lists["en/latin"]
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert got[2007] == f"{GERMAN} y7 {('Xyz ' * 40).strip()}"  # 'xyz' is on every page in German
    assert got[3000].startswith(GERMAN) and got[3001] == LONG


def test_stop_words_without_a_limit(spark):
    many = " ".join(f"w{k}" for k in range(2500))
    pages = spark.createDataFrame([(k, f"<p>{many} x{k}</p>") for k in range(60)], "page_id long, html string")
    assert len(H.stop_words(pages)) == 2500


@pytest.mark.parametrize("stop", [frozenset(), H.Lists({}), H.Lists({"en/latin": STOP}), STOP])
def test_pages_without_known_stop_words_keep_their_text(stop):
    page = f"<html lang=pl><p>{'Wyszli oni tam bez niczego '*5}</p><p>Tak.</p><p>{'Nikt im nie wierzy '*5}</p><div><a href=x>{LONG}</a></div></html>"
    assert H.first_pass(H.Block(LONG, 0, 0), frozenset()) == H.OPEN
    assert H.main_text(page, stop) == f"{('Wyszli oni tam bez niczego '*5).strip()} Tak. {('Nikt im nie wierzy '*5).strip()}"


@pytest.mark.parametrize(
    "page, group",
    [
        ("<p>plain", "/latin"),
        ('<!DOCTYPE html><HTML data-lang=xx class="a" LANG="pt-BR"><p>Olá, você', "pt/latin"),
        ("<html lang=ru><p>Привет, мир HTML", "ru/cyrillic"),
        ("<html lang=klingon><p>日本語のテキスト", "/cjk"),
        ("<html lang=''><p>ελληνικά 12345 67890", "/greek"),
        ("", "/latin"),
    ],
)
def test_groups(page, group):
    assert H.group_of(page, H.blocks(page)) == group


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "content-with-banner", "post comments-open", "share", "page widget"])
@pytest.mark.parametrize("tag", ["article", "main", "div role='main'"])
def test_articles_in_named_wrappers_stay(wrapper, tag):
    article = f"<{tag}><p>{LONG}</p><div class='ad'>{OTHER}</div></{tag.split()[0]}>"
    assert text(f'<div class="{wrapper}">{article}<p>{OTHER}</p></div>') == LONG
    assert text(f'<main><h1>Head</h1><section id="{wrapper}">{article}</section></main>') == f"Head {LONG}"


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "content-with-banner", "post comments-open", "no-ads", "my-ad-free-page"])
def test_names_of_states_and_middle_parts_ban_nothing(wrapper):
    assert text(f'<div class="{wrapper}"><p>{LONG}</p></div>') == LONG


def test_comments_and_teasers_as_articles_are_left_out():
    comments = f'<ol class="comment-list"><li><article><p>{OTHER}</p></article></ol>'
    assert text(f"<article><p>{LONG}</p></article>{comments}") == LONG
    assert text(f"<article><p>{LONG}</p>{comments}</article>") == LONG
    assert text(f'<div class="widget"><article><p>{LONG}</p></article>{comments}</div>') == LONG
    assert text(f'<main><p>{LONG}</p><section class="related-posts"><article><p>{OTHER}</p></article></section></main>') == LONG


@pytest.mark.parametrize("attrs", ['class="hidden md:block"', 'title="a hidden gem"', 'data-x="display:none"', 'title="class=ad"', 'alt="is aria-hidden=true"'])
def test_hidden_is_an_attribute(attrs):
    assert text(f"<article><p {attrs}>{LONG}</p></article>") == LONG


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN=''", "class=x hidden", "aria-hidden='true'", "style='Visibility : hidden'", "id='ad'"])
def test_hidden_attributes_hide(attrs):
    assert text(f"<article><p>{LONG}</p><div {attrs}>{OTHER}</div></article>") == LONG


@pytest.mark.parametrize("sizes", [(1, 2, 3), (20, 21), (58, 59, 60, 61), (119, 120, 121)])
def test_one_page_more_changes_no_text(spark, sizes):
    """Pages of a small language beside those of a large one: their texts don't jump with the number of pages."""
    english = [(10_000 + k, "u", f"<html lang=en><article><p>{LONG} z{k}</p></article>") for k in range(150)]
    page = "<html lang=de><div><p>{0} y{1}</p><p>Kurz und gut.</p><div>{2}</div><p>{0}</p></div>"
    german = [(k, "u", page.format(GERMAN, k, "Impressum Kontakt " * 6)) for k in range(max(sizes))]
    texts = []
    for n in sizes:
        pages = spark.createDataFrame(english + german[:n], "page_id long, url string, html string").coalesce(2)
        texts.append({r["page_id"]: r["text"] for r in H.extract(pages).collect()})
    for smaller, larger in zip(texts, texts[1:]):
        assert all(larger[k] == text for k, text in smaller.items())


def test_pages_that_name_no_language_take_the_list_that_knows_them():
    lists = H.Lists({"en/latin": frozenset("the of and is".split()), "de/latin": frozenset("der die und ist".split()), "/latin": frozenset("x y z".split())})
    of = lambda page: lists.of(page, H.blocks(page))
    assert of("<p>der Hund und die Katze") == lists.lists["de/latin"]
    assert of("<p>the end of it") == lists.lists["en/latin"]
    assert of("<p>x x x") == lists.lists["/latin"]
    assert of("<p>und the") == lists.lists["de/latin"]  # a tie goes to the smaller name
    assert of("<html lang=fr><p>the of") == frozenset() and of("<p>привет") == frozenset()
