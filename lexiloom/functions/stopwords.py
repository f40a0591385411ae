"""English stop words: standard, extended by common words of little content, and by those of diaries.

Each set contains the one before. Words are kept by length and ending.
"""

STANDARD = frozenset(
    """
a d i m s t be he me re ve we if of ll am an in on do no so to up or as is at it by my had did and she the are
off all him can own who too her for our has was his its not but out you few how now why any same some here
were more have each such with both will them whom from than been then when down also into over your does this
hers ours that what most just they only very while there where these those above being doing which until under
other after their yours about below should before itself myself during having theirs because himself herself
through between against yourself ourselves themselves yourselves
""".split()
)

EXTENDED = STANDARD | frozenset(
    """
go bad add led old end see die one use ate big ask ran ten win won run ago two eat sat get let met set yet bit
hit sit got lot cut put saw new low six day may pay say way try buy idea head lead read need died used paid
said held hold told hand send find kind mind good hard face nice made side life make take wake like woke able
came time come home fine nine gone type wore sure case rise lose rose late true gave five give live love move
hang long hung much high wish push back pick week talk walk look took work real feel call fall fell tell well
fill full pull seem room mean seen open even worn turn keep help drop stop hear wear year ever four pass lots
days fact meet left wait felt want sent went kept part sort last best rest lost must next draw knew drew grew
show know grow play stay away many easy added ended tried asked lived loved moved build world could would
stand spend found stood heard maybe place three spoke broke whole raise sense worse house write quite wrote
leave drive drove serve stuff thing going bring using dying along wrong reach catch watch month speak break
drank think drink drunk shall small still began woken risen eaten often seven given begin learn begun drawn
shown known grown sleep clear offer later never hands times cases weeks years facts parts great eight might
night right built meant spent point slept start short first worst threw allow throw today early enjoy carry
needed wished pushed picked talked walked looked worked called filled pulled seemed opened turned helped
raised passed waited wanted rested served showed played stayed around notice decide change people little
became become anyone create adding ending seeing making taking waking asking coming rising losing eating
giving living loving moving paying saying trying buying though enough spoken broken fallen happen driven
person thrown appear number wonder rather better places things months across points always expect caught
bought moment almost follow anyway nobody likely really mainly simply mostly slowly instead noticed decided
changed reached watched carried learned dropped stopped offered created started allowed enjoyed provide
include example someone believe realize leading reading needing holding sending finding hanging wishing
pushing nothing picking talking walking looking working feeling calling falling telling filling pulling
seeming meaning opening evening winning running morning turning keeping helping hearing wearing raising
passing meeting waiting writing wanting resting getting hitting sitting cutting putting leaving driving
serving drawing showing knowing growing playing staying several written explain certain mention however
perhaps numbers tonight thought brought already anybody quickly finally totally usually exactly provided
included happened appeared wondered expected believed followed realized possible everyone continue noticing
deciding building standing spending changing bringing reaching catching watching speaking breaking thinking
drinking becoming learning sleeping dropping stopping offering creating starting allowing throwing enjoying
carrying although remember consider examples tomorrow probably entirely actually suddenly slightly recently
honestly explained mentioned continued providing including something happening beginning appearing wondering
expecting believing following realizing afternoon sometimes important different yesterday everybody basically
generally literally certainly obviously currently remembered considered understand understood everything
explaining mentioning continuing completely definitely absolutely especially eventually apparently remembering
considering specifically particularly understanding
""".split()
)

JOURNAL = EXTENDED | frozenset(
    """
log huh hmm yep wow page nope note yeah soon mins reps sets okay kinda wanna gonna sorta gotta noted super
pages notes hours guess draft entry logged record awhile drafts lately pretty figured routine suppose logging
journal session minutes reflect workout somehow recorded anything whenever wherever whatever somewhat
recording journaling reflecting reflection
""".split()
)
