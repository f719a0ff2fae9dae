"""Pages written by hand in layouts of their own, with the blocks of their main text."""

NEWS = ("""<!doctype html><html lang=en><head><title>Harbour bridge reopens</title><style>p{margin:0}</style></head><body>
<div class="skip"><a href="#c">Skip to content</a></div>
<header role="banner"><a href="/">The Evening Post</a><nav><ul><li><a href=/w>World</a><li><a href=/b>Business</a><li><a href=/s>Sport</a></ul></nav></header>
<div class="cookie-consent"><p>We use cookies to improve your visit. <a href=/p>Read our policy</a></p><button>Accept</button></div>
<main><article><h1>Harbour bridge reopens after two years of repairs</h1>
<p>The old harbour bridge carried its first cars in more than two years on Monday morning, after engineers replaced every one of its hangers.</p>
<p>Traffic was light at first. By noon, though, queues had formed on both banks, and the police asked drivers to use the tunnel.</p>
<aside class="related"><h3>Related</h3><ul><li><a href=1>Tunnel toll to rise</a><li><a href=2>Ferry service cut</a></ul></aside>
<h2>What the work cost</h2>
<p>The council puts the bill at forty million, a third more than planned; most of the difference went into steel, it said in a statement.</p>
<blockquote><p>"We found corrosion where nobody had looked since the bridge was built," said the chief engineer.</p></blockquote>
<p>A second phase, which repaints the towers, begins next spring and will not close the road.</p></article>
<section id="comments"><h2>Comments</h2><div class="comment"><b>anna77</b><p>About time, I say. I lost an hour every day because of this bridge.</p></div></section></main>
<footer><p>Copyright The Evening Post. All rights reserved. <a href=/i>Imprint</a></p></footer></body></html>""",
["Harbour bridge reopens after two years of repairs",
 "The old harbour bridge carried its first cars in more than two years on Monday morning, after engineers replaced every one of its hangers.",
 "Traffic was light at first. By noon, though, queues had formed on both banks, and the police asked drivers to use the tunnel.",
 "What the work cost",
 "The council puts the bill at forty million, a third more than planned; most of the difference went into steel, it said in a statement.",
 '"We found corrosion where nobody had looked since the bridge was built," said the chief engineer.',
 "A second phase, which repaints the towers, begins next spring and will not close the road."])

BLOG = ("""<html><body class="home"><div id="wrap"><div id="masthead"><h1><a href="/">Slow Bread</a></h1><p>Notes from a small kitchen</p></div>
<div id="menu"><a href="/">Home</a> <a href="/about">About</a> <a href="/recipes">Recipes</a> <a href="/contact">Contact</a></div>
<div id="main"><div class="post"><h2>Rye without a tin</h2><div class="entry">
<p>I had always baked rye in a tin, because the dough runs. Last week I ran out of tins and learned something.</p>
<p>Here is what you need:</p><ul><li>500 g of coarse rye flour, as fresh as you can get it,</li><li>400 g of water that is warm but not hot,</li><li>a cup of sour starter.</li></ul>
<p>Mix everything, wait four hours, then shape the loaf with wet hands. Do not knead it; rye has no use for kneading.</p>
<p>Bake it hot for a quarter of an hour and then at a lower heat until it sounds hollow. Let it rest for a day, if you can.</p></div>
<div class="sharing"><a href="#">Tweet</a> <a href="#">Pin it</a> <a href="#">Mail</a></div></div></div>
<div id="sidebar"><div class="widget"><h3>Archive</h3><ul><li><a href="/1">January</a></li><li><a href="/2">February</a></li><li><a href="/3">March</a></li></ul></div>
<div class="widget"><h3>Subscribe</h3><form><input name="m"><p>Get new posts by mail.</p></form></div></div>
<div id="footer">Slow Bread is powered by flour and water. Theme by nobody.</div></div></body></html>""",
["Rye without a tin",
 "I had always baked rye in a tin, because the dough runs. Last week I ran out of tins and learned something.",
 "Here is what you need:", "500 g of coarse rye flour, as fresh as you can get it,", "400 g of water that is warm but not hot,", "a cup of sour starter.",
 "Mix everything, wait four hours, then shape the loaf with wet hands. Do not knead it; rye has no use for kneading.",
 "Bake it hot for a quarter of an hour and then at a lower heat until it sounds hollow. Let it rest for a day, if you can."])

TABLES = ("""<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD COLSPAN=2><A HREF=/>Modellbahnfreunde e.V.</A> | <A HREF=n>Neues</A> | <A HREF=t>Termine</A> | <A HREF=k>Kontakt</A></TD></TR>
<TR><TD VALIGN=top WIDTH=150><UL><LI><A HREF=1>Anlagen</A><LI><A HREF=2>Fahrzeuge</A><LI><A HREF=3>Bastelecke</A><LI><A HREF=4>G&auml;stebuch</A></UL></TD>
<TD VALIGN=top><H1>Ein Bahnhof aus Pappe</H1><P>Wer mit wenig Geld anf&auml;ngt, baut seinen ersten Bahnhof aus Pappe. Das h&auml;lt l&auml;nger, als man denkt, und sieht auch noch gut aus.
<P>Man braucht feste Graupappe, ein scharfes Messer und Geduld. Die W&auml;nde werden doppelt geklebt, damit sie sich nicht verziehen.
<P>Das Dach kommt zuletzt. Wir haben es mit Wasserfarbe gestrichen, zweimal d&uuml;nn statt einmal dick, und nach dem Trocknen matt lackiert.</TD></TR>
<TR><TD COLSPAN=2><FONT SIZE=1>&copy; Modellbahnfreunde. <A HREF=i>Impressum</A></FONT></TD></TR></TABLE></BODY></HTML>""",
["Ein Bahnhof aus Pappe",
 "Wer mit wenig Geld anfängt, baut seinen ersten Bahnhof aus Pappe. Das hält länger, als man denkt, und sieht auch noch gut aus.",
 "Man braucht feste Graupappe, ein scharfes Messer und Geduld. Die Wände werden doppelt geklebt, damit sie sich nicht verziehen.",
 "Das Dach kommt zuletzt. Wir haben es mit Wasserfarbe gestrichen, zweimal dünn statt einmal dick, und nach dem Trocknen matt lackiert."])

DOCS = ("""<!DOCTYPE html><html><head><meta charset=utf-8><title>Queues</title><script>var p = "<p>no</p>";</script></head><body>
<nav class="topbar"><a href="/">Docs</a><a href="/api">API</a><a href="/faq">FAQ</a></nav>
<div class="layout"><aside class="toc"><ol><li><a href="#a">Overview</a></li><li><a href="#b">Limits</a></li><li><a href="#c">Retries</a></li></ol></aside>
<div class="content" data-k="main"><h1>Queues</h1><p>A queue keeps messages until a worker takes them. Messages leave in the order in which they came, unless a worker fails.</p>
<h2>Limits</h2><p>A message may hold up to 256 KB. Larger ones are refused, and the sender gets an error that names the size.</p>
<table><tr><th>Plan</th><th>Messages</th></tr><tr><td>Small</td><td>one million</td></tr></table>
<h2>Retries</h2><p>A message that a worker does not confirm within a minute goes back to the front of the queue; after five such returns it is set aside.</p>
<pre>queue.retry(limit=5)</pre></div></div>
<div class="footer"><a href="/legal">Legal</a> <a href="/privacy">Privacy</a></div></body></html>""",
["Queues", "A queue keeps messages until a worker takes them. Messages leave in the order in which they came, unless a worker fails.",
 "Limits", "A message may hold up to 256 KB. Larger ones are refused, and the sender gets an error that names the size.",
 "Plan", "Messages", "Small", "one million", "Retries",
 "A message that a worker does not confirm within a minute goes back to the front of the queue; after five such returns it is set aside.", "queue.retry(limit=5)"])

SECTIONS = ("""<html><body><section class="promo-strip"><p>Save 20% on every annual plan until Friday!</p></section>
<div class="page"><section class="story"><h1>La sécheresse change les jardins</h1><p class="lead">Dans le sud, les pelouses disparaissent. À leur place poussent des herbes qui demandent peu d'eau.</p>
<p>Le jardinier municipal a commencé il y a trois ans, sur une place où rien ne tenait. Aujourd'hui, on y trouve du thym, de la sauge et des graminées.</p>
<div class="ad-slot"><p>Publicité : les meilleurs tuyaux d'arrosage sont ici.</p></div>
<p>Les habitants, d'abord sceptiques, s'y sont faits; plusieurs ont copié l'idée chez eux, et la mairie distribue désormais des plants.</p></section>
<section class="newsletter"><h3>Restez informés</h3><p>Recevez nos articles chaque matin.</p></section></div>
<footer class="site-foot">Mentions légales</footer></body></html>""",
["La sécheresse change les jardins", "Dans le sud, les pelouses disparaissent. À leur place poussent des herbes qui demandent peu d'eau.",
 "Le jardinier municipal a commencé il y a trois ans, sur une place où rien ne tenait. Aujourd'hui, on y trouve du thym, de la sauge et des graminées.",
 "Les habitants, d'abord sceptiques, s'y sont faits; plusieurs ont copié l'idée chez eux, et la mairie distribue désormais des plants."])

PAGES = {"news": NEWS, "blog": BLOG, "tables": TABLES, "docs": DOCS, "sections": SECTIONS}
