"""Hand-written pages of many layouts.  What stands in [[ ]] is main text, a block each."""

LONG = [
    "The ferry left the harbour before dawn, and by the time the sun rose over the islands the coast was only a thin grey line. Most of the passengers slept on the benches below deck, wrapped in coats and blankets against the cold.",
    "Nobody had told the engineers that the bridge would have to carry trains as well. They had planned for carts, for cattle and for a few hundred walkers a day, and the first drawings show no more than that.",
    "In the years after the war the orchard was let to a family from the valley, who kept it for three generations. They grafted old sorts on young stems, sold the fruit at the gate, and wrote down every harvest in a ledger that still exists.",
    "Water boils at a lower temperature in the mountains, which is why beans take so long to cook there. A pressure cooker helps, but so does patience, a good fire and a pot with a heavy lid.",
    "The committee met eleven times, heard forty witnesses and read more than two thousand pages of letters. Its report was short. It said that the dam was safe, that the spillway was not, and that both should have been inspected years ago.",
    "She learned to read music from her grandmother, who could not hear it any more but knew by heart how each piece was fingered. They sat at the table and played on the wood.",
]
SHORT = ["Yes.", "It was late.", "Nobody answered, of course.", "So they went home.", "A list of what is needed follows.", "That was all."]
LIST = ["two onions, chopped", "a spoon of oil", "one litre of stock", "salt and pepper"]
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/a">About us</a></li><li><a href="/c">Contact</a></li></ul>'
RELATED = '<ul><li><a href="/1">Ten harbours to see this year</a></li><li><a href="/2">Why old bridges last</a></li><li><a href="/3">Apples that keep all winter</a></li></ul>'
COMMENTS = "<p>I remember that ferry very well, my uncle worked on it for years. Thank you for writing about it.</p><p>Not quite right, the bridge was rebuilt twice.</p>"
P, H, S = "<p>[[{}]]</p>", "<h1>[[A morning on the coast]]</h1>", "<h2>[[What came after]]</h2>"
P2, P3, P4 = P + P, P * 3, P * 4
FOOT = "<footer>&copy; 2021 The Coast Courier. All rights reserved.</footer>"

LAYOUTS = [
    # names of parts on the body and on wrappers
    f"<body class='page header-fixed sidebar-right has-comments'><article>{P4}</article></body>",
    f"<body class='single has-sidebar comments-open'><div class='entry-content'>{H}{P4}</div></body>",
    f"<body class='has-header'><main>{H}{P4}</main></body>",
    f"<div class='with-sidebar layout'><div class='content'>{H}{P4}</div></div>",
    f"<form id='aspnetForm'><div class='content'>{H}{P4}</div></form>",
    f"<article class='film-reviews'>{H}{P4}</article>",
    f"<article id='privacy-law-explained'>{H}{P4}</article>",
    f"<div class='inhalt'>{H}{P4}</div>",
    f"<div>{H}{P4}</div>",
    "[[{}]]",
    # news and blogs
    f"<header><a href='/'>The Coast Courier</a>{NAV}</header><main><article>{H}{P3}{S}{P2}</article></main><aside class='sidebar'><h3>Most read</h3>{RELATED}</aside>{FOOT}",
    f"<div id='page' class='site'><header id='masthead' class='site-header'><p class='site-title'><a href='/'>Harbour notes</a></p><nav id='site-navigation'>{NAV}</nav></header><div id='content' class='site-content'><div id='primary' class='content-area'><main id='main' class='site-main'><article id='post-12' class='post type-post status-publish format-standard category-news'><div class='entry-content'>{P4}</div></article><div id='comments' class='comments-area'><h2 class='comments-title'>2 thoughts</h2>{COMMENTS}</div></main></div><div id='secondary' class='widget-area'><section class='widget'><h2>Recent posts</h2>{RELATED}</section></div></div><footer id='colophon' class='site-footer'>Proudly made by hand</footer></div>",
    f"<div class='wrap'><div class='topbar'><a href='/login'>Sign in</a> <a href='/subscribe'>Subscribe</a></div><div class='story-body'>{H}{P4}</div><div class='share-tools'><a href='#'>Share</a> <a href='#'>Print</a></div><div class='related'><h4>More like this</h4>{RELATED}</div></div>",
    f"<nav>{NAV}</nav><section class='article'>{H}{P2}<div class='advert'>Advertisement</div>{P2}</section>{FOOT}",
    f"<div class='blog-post'>{H}{P3}<div class='newsletter'><form><p>Get our letter every Friday.</p><input name='e'></form></div>{P}</div><div class='comments'>{COMMENTS}</div>",
    f"<article>{H}{P3}<section class='comments'><h3>Comments</h3>{COMMENTS}</section></article>",
    f"<main>{H}{P2}<figure><img src='x.jpg'><figcaption>[[The harbour in winter, seen from the old mole.]]</figcaption></figure>{P2}</main><footer class='footer'>{NAV}</footer>",
    f"<div class='cookie-banner'><p>We use cookies to make this site work. You may accept or refuse them.</p><button>Accept</button></div><article>{H}{P4}</article>{FOOT}",
    f"<div id='header'>{NAV}</div><div id='breadcrumb'><a href='/'>Home</a> / <a href='/n'>News</a></div><div id='main'>{H}{P4}</div><div id='footer'>Imprint</div>",
    f"<table><tr><td class='menu'>{NAV}</td><td class='text'>{H}{P4}</td></tr></table>",
    # recipes, guides, lists, quotes, code
    f"<main><article class='recipe'>{H}{P}<ul>{{list}}</ul>{P2}</article></main><aside>{RELATED}</aside>",
    f"<article class='post'>{H}{P}<blockquote>[[{{}}]]</blockquote>{P2}</article>{FOOT}",
    f"<article><h1>[[How to print a table]]</h1>{P}<pre>[[print(table)]]</pre>{P}</article><nav class='pager'><a href='/p'>Previous</a> <a href='/n'>Next</a></nav>",
    f"<div class='page-content'>{H}{P}<table><tr><td>[[Length]]</td><td>[[214 metres]]</td></tr><tr><td>[[Built]]</td><td>[[1887 to 1891]]</td></tr></table>{P2}</div><div class='ads'>Buy two, pay one.</div>",
    f"<main id='content'><section>{H}{P2}</section><section>{S}{P2}</section><section><h2>[[Where it ended]]</h2>{P}</section></main><footer>{NAV}</footer>",
    f"<div class='post-content'><div class='row'>{P2}</div><div class='row'>{P2}</div></div><div class='sidebar'>{RELATED}</div>",
    f"<article>{H}<p>[[{{short}}]]</p>{P}<p>[[{{short}}]]</p><p>[[{{short}}]]</p>{P}</article>{FOOT}",
    # without names
    f"<nav>{NAV}</nav><div>{H}{P4}</div>{FOOT}",
    f"<div><div><a href='/'>Home</a> <a href='/n'>News</a> <a href='/m'>More</a></div><div>{H}{P4}</div><div>© 2020 Some Paper</div></div>",
    f"<div class='zuko'><ul class='mipa'><li><a href='/'>Start</a></li><li><a href='/b'>Board</a></li></ul><div class='reto'>{P4}</div><div class='lofi'><a href='/i'>Imprint</a></div></div>",
    "<body>{}<br><br>{}</body>".replace("{}<br><br>{}", "[[{} {}]]"),
    "<h1>[[A letter]]</h1>" + P4,
    f"<div id='inhalt'><h1>[[Morgens an der Küste]]</h1>{P4}</div><div id='fuss'>© Küstenblatt</div>",
    f"<div class='contenido'>{H}{P3}</div><div class='pie'>&copy; 2019 El Faro</div>",
    f"<ul>{'<li><a href=/x>Link</a></li>' * 6}</ul>{H}{P4}<hr>{RELATED}",
    # one-column pages with rest of every kind
    f"<body class='archive-single with-nav'><div class='container'><div class='banner'>Spring sale: all maps at half price</div><div class='article-body'>{H}{P3}</div><div class='tags'><a href='/t/sea'>sea</a> <a href='/t/boat'>boat</a></div><div class='author-box'></div><div class='pagination'><a href='/2'>Next page</a></div></div></body>",
    f"<main role='main'><article role='article'>{H}{P4}</article></main><div role='complementary' class='sidebar'>{RELATED}</div><div role='contentinfo' class='footer'>Imprint and privacy</div>",
    f"<section class='section section-main'><div class='text'>{H}{P3}</div></section><section class='newsletter-signup'><h3>Stay in touch</h3><p>Leave us your address and we will write once a month.</p></section>",
    f"<article class='has-sidebar comments-closed'><header>{H}</header><div class='prose'>{P4}</div></article><div class='popular'><h3>Popular</h3>{RELATED}</div>".replace("<header>" + H + "</header>", H),
    f"<div class='site-wrapper no-sidebar'><div class='content-wrapper'><div class='story'>{P4}</div></div></div><div class='modal'><p>Please log in to go on.</p></div>",
    f"<div class='document'><div class='body'>{H}{P2}{S}{P2}</div></div><div class='sphinxsidebar'>{NAV}</div><div class='footer'>Built last night.</div>",
    f"<div class='forum-topic'><article class='main-post'>{P3}</article></div><div class='replies'>{COMMENTS}</div>",
    f"<article>{H}{P3}<aside class='promo'><p>Our book of harbours is out now.</p></aside>{P2}<footer><p>Filed under: coast</p></footer></article>",
    f"<div class='wide-layout'><main class='main-content' id='about-the-footer-law'>{H}{P4}</main></div>{FOOT}",
    f"<div class='notice'>This site will be down on Sunday.</div><div class='content'>{H}<div>[[{{}}]]</div><div>[[{{}}]]</div><div>[[{{}}]]</div></div>{FOOT}",
    f"<body><center>{H}</center>{P4}<p><a href='/'>back</a></p></body>".replace("<p><a href='/'>back</a></p>", "<nav><a href='/'>back</a></nav>"),
]


def pages():
    """(html, main text) of each layout, filled with prose."""
    for number, layout in enumerate(LAYOUTS):
        html, k = layout.replace("{list}", "".join(f"<li>[[{x}]]</li>" for x in LIST)), number
        while "{}" in html:
            html, k = html.replace("{}", LONG[k % len(LONG)], 1), k + 1
        while "{short}" in html:
            html, k = html.replace("{short}", SHORT[k % len(SHORT)], 1), k + 1
        yield html.replace("[[", "").replace("]]", ""), "\n".join(x.split("]]")[0] for x in html.split("[[")[1:])
