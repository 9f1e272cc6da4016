"""Pages written and labelled by hand, in layouts that the generator of training pages doesn't have.

``[[`` and ``]]`` enclose each block of the main text.  No page uses a class or id that names its part of the page,
unless that is usual for the layout (``mw-``, ``td``, ``col``), and the prose is plain English.
"""

from __future__ import annotations

import re

PAGES = [
    # nested divs without names
    """<html><body><div><div><a href=/>Home</a> | <a href=/w>World</a> | <a href=/s>Sport</a> | <a href=/m>Money</a></div></div><div><div><div><h1>[[River town rebuilds its bridge]]</h1>
    <p>[[The old bridge fell in the spring flood of last year, and people have crossed by ferry since then.]]</p><p>[[On Tuesday the council opened a new one, built of steel and oak, a little further up the river.]]</p></div></div>
    </div><div><div>Copyright 2019 The Valley Times. All rights reserved.</div></div></body></html>""",
    # table layout of the nineties
    """<html><body bgcolor=white><table width=100%><tr><td colspan=2><font size=1><a href=a.html>Index</a> <a href=b.html>Next</a> <a href=c.html>Previous</a></font></td></tr><tr><td width=120><a href=1>Boats</a><br><a href=2>Ropes</a><br><a href=3>Knots</a></td>
    <td><h2>[[How to tie a bowline]]</h2><p>[[Make a small loop in the standing part of the rope. Pass the end up through the loop, round the back, and down again.]]<p>[[Pull it tight. The knot holds well, and it can be undone after a heavy load.]]</td></tr></table>
    <hr><font size=1>Copyright 1998 by the sailing club.</font></body></html>""",
    # a plain text page with headings
    """<h1>[[Notes on keeping bees]]</h1><p>[[A hive needs a dry stand, some shade at noon, and water not far away.]]</p><h2>[[Spring]]</h2><p>[[Open the hive on the first warm day and look for eggs. If you see none, the colony has lost its queen.]]</p><h2>[[Autumn]]</h2><p>[[Take no honey after August, since the bees need it for the winter.]]</p>""",
    # section pages
    """<body><div><ul><li><a href=/1>Recipes</a></li><li><a href=/2>Kitchen</a></li><li><a href=/3>About</a></li></ul></div><section><h1>[[Lentil soup]]</h1><p>[[This soup takes half an hour and feeds four people.]]</p><h3>[[Ingredients]]</h3><ul><li>[[Two cups of red lentils]]</li><li>[[One onion, chopped]]</li><li>[[A spoon of cumin]]</li></ul>
    <h3>[[Method]]</h3><ol><li>[[Fry the onion until it is soft.]]</li><li>[[Add the lentils and a litre of water, and cook for twenty minutes.]]</li></ol></section><div><a href=/4>Privacy</a> <a href=/5>Terms</a> <a href=/6>Contact</a></div></body>""",
    # main in a grid
    """<body><header><div><a href=/>The Garden Post</a></div></header><div class=row><div class="col-8"><h1>[[Why roses need pruning]]</h1><p>[[A rose that is never cut grows tall and thin, with few flowers at the very top.]]</p><p>[[Cut it back to the third bud in late winter, when the hard frosts have passed.]]</p></div><div class="col-4"><h4>Popular</h4><ul><li><a href=/x>Ten plants for shade</a></li><li><a href=/y>When to sow beans</a></li></ul></div></div><footer><p>© The Garden Post</p></footer></body>""",
    # encyclopedia
    """<body><div id=mw-head><a href=/r>Read</a> <a href=/e>Edit</a> <a href=/h>View history</a></div><div id=mw-content-text><p>[[The lynx is a cat of middle size with tufted ears and a short tail.]]</p><p>[[It lives in the forests of the north and hunts hares by night; in a <a href=/year>good year</a> a pair may raise four young.]]</p><h2>[[Range]]</h2><p>[[Lynxes were once found in most of Europe. They have returned to some of the mountains in the last fifty years.]]</p></div><div><ul><li><a href=/p>Privacy policy</a></li><li><a href=/d>Disclaimers</a></li></ul></div></body>""",
    # weblog with a date in the header and comments in plain lists
    """<body><div><h2><a href=/>Notes from the shed</a></h2></div><article><h1>[[A new workbench]]</h1><p>[[I spent the weekend building a bench from old floor boards, and it cost me nothing but screws.]]</p><p>[[The legs are bolted, so it can be taken apart when we move.]]</p></article><div><h3>3 comments</h3><ol><li><p>Nice work, I want one too!</p></li><li><p>What did you use for the top?</p></li><li><p>Reply to both: beech.</p></li></ol></div><footer>Powered by hope</footer></body>""",
    # documentation
    """<body><aside><ul><li><a href=/i>Install</a></li><li><a href=/c>Configure</a></li><li><a href=/r>Run</a></li></ul></aside><main><h1>[[Configure the server]]</h1><p>[[The server reads one file when it starts. Each line has a name and a value.]]</p><pre>[[port = 8080 host = localhost]]</pre><p>[[Restart the server after each change, as it does not watch the file.]]</p></main><footer><a href=/l>License</a></footer></body>""",
    # mailing list
    """<body><div><a href=/p>[Prev]</a> <a href=/n>[Next]</a> <a href=/t>[Thread]</a></div><h1>[[Question about the tide tables]]</h1><p>[[Hello all, the tables for next month seem to be an hour late from the tenth on.]]</p><p>[[Has anyone else seen this, or is my clock wrong? Thanks for any help.]]</p><hr><div><a href=/u>Unsubscribe</a> <a href=/a>Archive</a></div></body>""",
    # a consent box first, without a name
    """<body><div><div><p>We use cookies to improve your visit. Read our privacy policy.</p><button>OK</button></div></div><div><a href=/>Start</a> <a href=/f>Films</a> <a href=/b>Books</a></div><article><h1>[[A quiet film about trains]]</h1><p>[[Almost nothing happens in it, and yet nobody in the room looked at the clock.]]</p><p>[[The camera stays in one carriage for ninety minutes, while the country goes by outside.]]</p></article></body>""",
    # a newsletter form in the middle
    """<body><nav><a href=/>Home</a></nav><main><h1>[[Walking the north coast]]</h1><p>[[The path starts at the harbour and climbs at once to the top of the cliffs.]]</p><form><p>Subscribe to our newsletter for more walks</p><input type=email><button>Send</button></form><p>[[After six miles it comes down to a beach, where there is an inn with good beds.]]</p></main></body>""",
    # related links after the text in an unnamed list
    """<body><div><div><h1>[[Market prices rise again]]</h1><p>[[Wheat cost more this week than at any time since the drought, traders said on Friday.]]</p><p>[[Millers have bought early, and they expect to pass on some of the cost to bakers by the end of the year.]]</p></div><div><h4>Read more</h4><ul><li><a href=/1>Drought hits the plains</a></li><li><a href=/2>Bakers warn of dear bread</a></li><li><a href=/3>What the harvest means</a></li></ul></div></div></body>""",
    # a forum question in a table
    """<body><table><tr><td><a href=/>Forum</a></td><td><a href=/l>Log in</a></td><td><a href=/r>Register</a></td></tr></table><table><tr><td><p>[[My pump starts and then stops after about ten seconds. I have cleaned the filter and checked the fuse.]]</p><p>[[It ran well until I moved it to the other tank. What else can I look at?]]</p></td></tr></table><div>Copyright the forum, all rights reserved</div></body>""",
    # a letter, short paragraphs
    """<body><div><p>[[Dear reader,]]</p><p>[[This is the last issue that I shall edit, and I want to thank you for eleven good years.]]</p><p>[[Keep well.]]</p></div><div><a href=/i>Issues</a> <a href=/a>Authors</a></div></body>""",
    # definition list
    """<body><div><a href=/>Glossary</a> <a href=/a>A</a> <a href=/b>B</a> <a href=/c>C</a></div><main><h1>[[Terms of the weaver]]</h1><dl><dt>[[Warp]]</dt><dd>[[The threads that are held tight on the loom.]]</dd><dt>[[Weft]]</dt><dd>[[The thread that is passed over and under them.]]</dd></dl></main><footer><p>Contact the museum</p></footer></body>""",
    # a figure with a caption, a quotation
    """<body><header><nav><a href=/>Home</a> <a href=/n>News</a></nav></header><article><h1>[[Storm takes the pier]]</h1><figure><img src=p.jpg><figcaption>[[The pier on Sunday morning.]]</figcaption></figure><p>[[Waves of six metres broke the last forty metres of the pier in the night.]]</p><blockquote>[[I have never heard such a noise in my life.]]</blockquote><p>[[No one was hurt, and the lighthouse is still working.]]</p></article><aside><p>Weather: rain, nine degrees</p></aside></body>""",
    # an advert between paragraphs, named only by its words
    """<body><div><div><h1>[[Learning to swim at sixty]]</h1><p>[[I was afraid of water all my life, and then my grandson asked me to come in.]]</p><div><a href=/x>Sponsored: goggles at half price</a></div><p>[[The first lesson was an hour of breathing out under water, and nothing else.]]</p><p>[[By the summer I could cross the pool, slowly, without stopping.]]</p></div></div></body>""",
    # share links at the end of the article
    """<body><article><h1>[[The clock in the square]]</h1><p>[[It has been nine minutes slow since the war, and the town likes it that way.]]</p><p>[[When a new mayor had it put right, so many people missed the bus that it was set back.]]</p><div><a href=/f>Share</a> <a href=/t>Tweet</a> <a href=/m>Mail</a></div></article><footer><div>© 2020</div></footer></body>""",
    # long text, few tags
    """<body><p><a href=/>back to the list of stories</a></p><p>[[There was a miller who had three sons, a mill, a donkey and a cat. When he died the eldest took the mill, the second the donkey, and the youngest got nothing but the cat.]]</p><p>[[He sat down on the step and said that he could have a pair of gloves made of its skin, and then he would have nothing at all.]]</p><p>[[But the cat had heard him, and it spoke. Give me a pair of boots, it said, and you will see that your share is not so bad.]]</p></body>""",
    # press release with contacts below
    """<body><div><a href=/>Company</a> <a href=/p>Products</a> <a href=/j>Jobs</a></div><div><h2>[[New plant opens in the north]]</h2><p>[[The plant makes glass from waste and will employ two hundred people by next summer.]]</p><p>[[It is the third that the company has built since it was founded by two chemists.]]</p></div><div><ul><li><a href=/c>Contact</a></li><li><a href=/s>Site map</a></li><li><a href=/l>Legal</a></li></ul></div></body>""",
    # search box above, pager below
    """<body><form><label>Search</label><input><button>Go</button></form><div><h1>[[Chapter four]]</h1><p>[[The road was dark, and they met no one until they came to the ford.]]</p><p>[[There a man stood with a lantern, and he would not tell them his name.]]</p></div><div><a href=/3>Previous chapter</a> <a href=/5>Next chapter</a></div></body>""",
    # two sections side by side, the second one is boilerplate by its links
    """<body><main><section><h2>[[What we found]]</h2><p>[[Of the forty wells that we tested, nine had more lead than the law allows.]]</p><p>[[All nine lie within a mile of the old battery works.]]</p></section></main><div><ul><li><a href=/1>Annual report</a></li><li><a href=/2>Members</a></li><li><a href=/3>Give</a></li></ul></div><div>All rights reserved.</div></body>""",
    # data table inside an article
    """<body><nav><ul><li><a href=/>League</a></li></ul></nav><article><h1>[[Results of the season]]</h1><table><tr><th>[[Club]]</th><th>[[Points]]</th></tr><tr><td>[[Harbour]]</td><td>[[41]]</td></tr><tr><td>[[Mill Lane]]</td><td>[[38]]</td></tr></table><p>[[Harbour won the league on the last day, with a goal in the final minute.]]</p></article><footer>Copyright the league</footer></body>""",
    # nothing but boilerplate
    """<body><nav><a href=/>Home</a> <a href=/l>Login</a></nav><form><p>Sign in to read</p><input><button>Sign in</button></form><footer>© Some press. All rights reserved. <a href=/t>Terms</a></footer></body>""",
]


def labelled() -> list[tuple[str, list[str]]]:
    """(html, texts of the content blocks in order)."""
    strip = lambda t: " ".join(re.sub(r"<[^>]*>", "", t).split())
    return [(p.replace("[[", "").replace("]]", ""), [strip(t) for t in re.findall(r"\[\[(.*?)\]\]", p, re.S)]) for p in PAGES]
