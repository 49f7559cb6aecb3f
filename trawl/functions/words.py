"""Word lists of the analysis chains."""

from __future__ import annotations

# fixed values: the word lists of the analysis chains
ENGLISH_SHORT = """
a an and are as at be but by for if in into is it no not of on or such
that the their then there these they this to was will with
""".split()

HTML_WORDS = """
a b i p br div span li ul ol dl dt dd em strong pre code blockquote img src
alt href http https www com org rel nofollow noreferrer target blank title
table tr td th thead tbody caption h1 h2 h3 h4 h5 h6 hr sup sub del ins
nbsp quot amp lt gt apos font style class id width height align
""".split()

ENGLISH_LONG = """
a about above after again against all am an and any are as at be because been
before being below between both but by cannot did do does doing down during
each few for from further had has have having he her here hers him his how i
if in into is it its me more most my no nor not of on once only or other our
out over own same she should so some such than that the their them then there
these they this those through to too under until up very was we were what
when where which while who whom why will with would you your
""".split()

MARKUP_WORDS = """
p a href http https br li ul code strong em div span nbsp quot amp rel
nofollow noreferrer blockquote pre img src
""".split()
