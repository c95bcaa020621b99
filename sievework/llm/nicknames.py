"""Short and pet forms of given names, a resource for comparing persons' names.

Common knowledge of name-giving, not taken from any table; a name outside it is compared by its letters.
"""

# A full form, then the forms it goes by.
FORMS = """
abigail abby gail
albert al bert bertie
alejandro alex jandro
alexander alex alec sandy sasha xander
alexandra alex sandra sasha
alfred alf fred freddie
andrew andy drew
anthony tony
antonio toni tonio
barbara barb babs
benjamin ben benny
bernard bernie
bertram bert
catherine cathy cate
charles charlie chuck chas
christopher chris kit
concepcion concha conchita
daniel dan danny
david dave davy
deborah deb debbie
dolores lola loli
donald don donnie
dorothy dot dottie dolly
edward ed eddie ted teddy ned
eleanor ellie nell nora
elizabeth liz beth betty eliza lizzie libby
enrique quique
eugene gene
ferdinand ferdi nando
florence flo florrie
frances fanny
francesco cesco franco
francis frank
francisco paco pancho curro
frederick fred freddie fritz
gerald gerry jerry
giovanni gianni vanni
giuseppe beppe peppe pino
gregory greg
guadalupe lupe lupita
guillermo memo
harold harry hal
heinrich heinz heiner
henry harry hank
ignacio nacho
isabella bella izzy
jacob jake
james jim jimmy jamie
jesus chuy chus
johannes hannes hans
john jack johnny
jonathan jon jonny nathan
jose pepe
joseph joe joey
josephine jo josie
katherine kate kathy katie kit kitty
kenneth ken kenny
lawrence larry laurie
leonard len lenny leo
luigi gigi
manuel manolo manu
margaret maggie peggy meg greta madge
margarete grete gretel
maria mia mitzi
martha patty
matthew matt
michael mike mick micky
nicholas nick nicky
patricia pat patty trish tricia
patrick pat paddy
peter pete
philip phil pip
rafael rafa
rebecca becca becky
richard rick dick ricky rich
robert bob rob bobby robbie bert
roberto beto
rosario charo
samuel sam sammy
sebastian seb bastian basti
sigmund sigi
stephen steve
susan sue susie
theodor theo
theodora dora thea
theodore theo ted teddy
theresa terry tess
thomas tom tommy
timothy tim
victoria vicky tori
vincent vince vinny
virginia ginny
walter walt
wilhelm willi helm
william will bill willy billy liam
yekaterina katya
"""


def groups() -> list[list[str]]:
    return [line.split() for line in FORMS.strip().split("\n")]
