"""Words and clause patterns of the abuse grammar. Fixed values of this engine's own grammar, folded: lower case, no accents."""

from __future__ import annotations

# Insulting names for a person, by language (plural endings are derived).
INSULT = """
idiot moron halfwit dimwit imbecile cretin dumbass asshole arsehole bastard bitch whore slut wanker prick scumbag scum loser slob pig rat cockroach parasite worm cripple retard clown twat cunt dickhead douchebag
jackass dipshit shithead fuckwit motherfucker fucker tosser bellend nitwit numbskull simpleton dunce vermin swine weasel leech maggot degenerate lowlife tramp hag skank hoe faggot dyke tranny spastic mongoloid savage subhuman
abruti cretin debile connard connasse conne salope salaud ordure pourriture porc rate encule pute putain bouffon imbecile idiote abrutie cretine crevure raclure enfoire batard batarde truie grognasse pouffiasse minable
clochard mongol taré tare tocard pedale tapette gouine sous-merde sousmerde fumier vermine cafard parasite
depp trottel schwein drecksack schlampe abschaum penner wichser arschloch hurensohn versager vollpfosten miststuck dreckskerl schweinehund hure nutte missgeburt spast spasti idiotin volldepp vollidiot blodmann dummkopf
penner pack gesindel ungeziefer mistkerl scheisskerl hirni spacko fotze drecksau kruppel ratte kakerlake parasit lugner
gilipollas cabron cabrona imbecil idiota basura cerdo cerda escoria puta zorra payaso inutil hijoputa mamon pendejo capullo maricon subnormal tarado tarada desgraciado desgraciada malnacido lameculos bastardo rata gusano
perra guarra cucaracha mentecato anormal retrasado
"""
# Insulting names of several words.
INSULT_PHRASES = ["piece of shit", "pieces of shit", "son of a bitch", "sons of bitches", "waste of space", "fils de pute", "sac a merde", "sous merde", "hijo de puta", "hijos de puta", "stuck scheisse", "brain dead"]
# Words that belittle a person when they stand with a person or an insult.
SLUR = """
stupid dumb pathetic filthy fat ugly lying smelly disgusting worthless spineless inbred braindead brain-dead brainless useless retarded moronic idiotic vile ignorant lazy greasy stinking rotten dirty repulsive despicable
sale gros grosse pauvre miserable sacre sacree stupide debile moche immonde infame degoutant degoutante degueulasse puant puante gras grasse laid laide
dumm dumme dummer dummes dummen blod blode bloder blodes fett fette fetter fettes dreckig dreckige dreckiger dreckiges erbarmlich erbarmliche erbarmlicher erbarmliches widerlich widerliche widerlicher widerliches hasslich
hassliche hasslicher hassliches faul faule fauler faules stinkend stinkende stinkender stinkendes verlogen verlogene verlogener verlogenes mies miese mieser mieses
gordo gorda asqueroso asquerosa patetico patetica miserable sucio sucia feo fea estupido estupida repugnante mentiroso mentirosa inutil tonto tonta vago vaga rastrero rastrera
"""
# People a review may turn against.
PERSON = """
you your youre u yourself yourselves he she him her they them whoever everyone everybody someone seller sellers driver drivers courier couriers reviewer reviewers owner owners woman women man men girl girls guy guys boy staff clerk
clerks manager managers person people team boss agent agents lady lot expert mother shopkeeper salesman saleswoman cashier employee employees folks cook waiter waitress postman technician kid kids buyer buyers customer customers
livreur livreuse vendeur vendeuse dame chef cheffe patron patronne celui celle gens equipe facteur facteurs employe employee homme femme type mec fille gerant gerante client clients tu toi vous il elle ils
fahrer fahrerin verkaufer verkauferin frau mann chef chefin wer du dich dir ihr euch er sie bote team mitarbeiter mitarbeiterin kollege kundin kunde typ kerl laden
vendedor vendedora jefe jefa quien equipo repartidor repartidora senor senora tio tia mujer hombre empleado empleada tu usted vosotros ustedes sois eres ellos ella
"""
# Groups of people, by origin, faith, sex, age or health; names of peoples are recognised by their endings.
GROUP = """
foreigners foreigner immigrants immigrant migrants migrant refugees refugee women woman men gays gay lesbians jews jew muslims muslim christians hindus blacks whites asians gypsies gypsy arabs africans disabled elderly cripples faith religion kind race
etrangers etranger etrangeres immigres migrants refugies femmes femme vieux vieilles juifs musulmans arabes noirs gitans handicapes religion race
auslander auslandern auslanderin migranten fluchtlinge frauen alten alte juden muslime araber schwarze zigeuner behinderte behinderten rasse
extranjeros extranjero inmigrantes migrantes refugiados mujeres viejos ancianos judios musulmanes arabes negros gitanos discapacitados religion raza
"""
GROUP_PHRASES = ["people of colour", "people of color", "old people", "people of that faith", "people of his faith", "people of her faith", "people of their faith", "that lot", "those people", "their kind", "his kind", "her kind", "hill folk", "gens de la bas", "gens de la-bas", "leute von druben", "gente de alli", "gente de alla", "gente de fuera", "los de esa religion", "gente de esa"]
# Endings of names of peoples, by language, with the words one of which stands near in front of them ("" for none needed); plurals of at least six letters.
PEOPLES = (
    (r"[a-z]{3,}(?:ians|eans|[bdfgklmnprstvwz]ans|inese|anese)", ""),
    (r"[a-z]{3,}(?:iens|iennes|ans|anes|ais|ois|oises)", "les ces des aux tous"),
    (r"[a-z]{3,}(?:ier|aner|ianer|ener|esen|ianern|anern)", "die diese diesen alle den typisch solche"),
    (r"[a-z]{3,}(?:anos|anas|enses|eses|inos|iegos)", "los las esos estos todos"),
    (r"[a-z]{3,}(?:ari|ani|ali|eri|aqi|aeli|egians|ians|an|ian|ese)", "a an the those these never all"),
)
# Words with such endings that name no people.
NO_PEOPLE = frozenset("plans loans fans cans pans vans beans jeans means oceans swans trans scans clans bans guardians radians medians mediums human humans woman women german-made safari ferrari organ orphan artisan urban veteran titan an can van man than pan fan ran plan scan clan ban swan loan clean mean bean jean papier bier klavier hier vier tier tiere turnier scharnier jais mais jamais anglais francais dans sans ans vers fois mois bois choix trois manos anos hermanos veranos granos planos".split())
# Wishes of death or harm, threats.
HARM_PHRASES = [
    "rot in hell", "burn in hell", "go to hell", "drop dead", "die alone", "choke on it", "get hit by a bus", "hit by a bus", "crawl back under your rock", "jump off a bridge", "go jump off", "kill yourself", "kill yourselves",
    "hang yourself", "stop breathing", "slit your throat", "break your legs", "burn your house", "burn down your", "won't be walking home", "wont be walking home", "won t be walking home", "die in a fire", "get cancer",
    "bruler en enfer", "brule en enfer", "brulez en enfer", "aller crever", "allez crever", "va crever", "tous crever", "se faire ecraser", "te faire ecraser", "faire ecraser", "vas le regretter", "va te pendre", "jeter sous un train",
    "in der holle schmoren", "in der holle", "vor den zug laufen", "hang dich auf", "bring dich um", "krepier", "krepiert", "krepieren", "von der brucke springen",
    "que los atropellen", "que te atropelle", "que lo atropellen", "que la atropellen", "que os atropellen", "arder en el infierno", "ardan en el infierno", "pudrirse en el infierno", "pudrete", "vas a enterar", "te voy a matar", "tirarse de un puente",
]
HARM_WORDS = "verrecken verreckt verreck crever creve crevez morirse muera mueran murais muerete muerase"
# Explicit wording that stands for itself.
EXPLICIT = """
horny nudes blowjob handjob cumshot gangbang dildo masturbate masturbating orgasm porn porno pussy cunnilingus fellatio deepthroat creampie bukkake milf
bandante bander bandais branler branle sucer suce baise baiser baisait chatte bite nichons sodomie
geil nacktfotos nacktbilder ficken gefickt fick muschi titten wichsen blasen schwanz
follar follarte follarme follamos chupar chuparme polla mamada cachonda cachondo tetas corrida desnuda desnudo
naked nude nude tits boobs suck sucking sucked fucking fuck fucked cock dick sex sexy jerk nue nu nackt sexo hot
"""
# Explicit words that leave little doubt where two explicit words meet.
STRONG_EXPLICIT = """
horny nudes blowjob handjob cumshot gangbang masturbate masturbating orgasm porn porno pussy fellatio deepthroat branler sucer baiser bander bandais nacktfotos nacktbilder ficken gefickt muschi titten
follar follarte follarme chuparme mamada cachonda cachondo tetas tits suck fuck fucking desnuda nue geil
"""
# Violent deeds, and what happens to somebody who is wished ill.
VIOLENT = """
kill murder hurt beat punch stab shoot strangle smash cripple bury burn slap choke destroy torture
tuer buter frapper casser demolir defoncer massacrer egorger cramer bruler
umbringen toten schlagen verprugeln erschiessen abstechen erwurgen fertigmachen kaputtmachen
matar pegar golpear romper reventar partir quemar apunalar
"""
ILL = "die dies died suffer suffers burn burns rot rots bleed bleeds crash crashes choke chokes drown drowns cancer krepierst krepiert stirbst stirbt leidest crever souffrir mourir sufras mueras"
ILL_PHRASES = ["run over", "hit by", "get hurt", "gets hurt", "beaten up", "lose your job", "break your neck", "break their necks", "fall down the stairs"]
WISH = "hope wish pray hopefully hoffentlich hoffe wunsche espere souhaite ojala espero deseo"
FUTURE = "will ll gonna going gotta shall werde werden wird vais va allons voy vamos"
# Being driven away or locked up.
EXPEL = """
deport deported expel expelled shipped ship send sent kicked kick thrown throw driven drive locked lock banished removed
jette jetes jeter vire vires virer chasse chasses chasser expulse expulses expulser renvoie renvoyer
abgeschoben abschieben rausgeworfen rauswerfen rausschmeissen weggesperrt ausgewiesen vertrieben
echen echar echarlos expulsen expulsar expulsarlos deporten deportar
"""
CRIME = "thieves thief liars liar criminals criminal crooks cheats scammers rapists terrorists animals beasts monsters parasites pests plague disease voleurs menteurs criminels animaux betes terroristes diebe lugner verbrecher tiere bestien terroristen ladrones mentirosos criminales animales bestias terroristas plaga"
# Insulting names that also have a harmless sense: they count only as the last word of their noun phrase.
DOUBLE = frozenset("pig pigs rat rats cockroach cockroaches worm worms bitch bitches bastard bastards clown clowns tramp hag hoe prick pricks swine weasel leech maggot maggots savage savages cripple slob parasite parasites vermin scum loser losers snake tool dog dogs ratte ratten schwein sau kakerlake rata ratas cerdo zorra perra gusano rat cafard porc truie".split())
# Words that may follow the last word of a noun phrase.
AFTER = frozenset("""
and or who whom that which at in on of from to with for by like as would will should could can can't cannot must may might is are was were isn isnt has have had do does did don didn won be been being so if when because while than then alive ever here there today again now always never all every not no nothing but yes you your i he she we they it this these those who're too
et ou qui que dont a au aux de du des en dans sur avec pour par comme est sont etait sera doit peut si quand car ne pas mais toi vous tu il elle ils ce cette et
und oder der die das den dem in an auf am im von vom zu zum mit fur bei wie ist sind war waren hat haben wird soll kann muss wenn weil als aber und du ihr er sie es lobt hier da nie immer allesamt am
y o que quien de del en con por para como es son era fue ha han debe puede si cuando porque pero tu usted el ella ellos pone aqui nunca siempre
""".split())
SELF = "i im ich je j yo we wir"
COPULA = "is are was were be being been am feel feels felt look looked seem seemed est sont etait suis serait ist sind war waren bin sei es son era eres sois soy fue parece"
REPORT = "called calls calling insulted insults abused said says told tells shouted shouts yelled screamed named labelled labeled accused traite traitee traites appele appelee dit disait crie hurle nannte nannten genannt beschimpft beschimpfte beleidigt beleidigte sagte meinte schrie llamo llamaron insulto insultaron dijo dijeron grito gritaron reported reports"
NEGATION = "not isnt isn aren arent wasn wasnt weren don doesn didn wouldn no never nobody none nor neither pas aucun aucune ni kein keine keiner keinen nicht nie ningun ninguna nunca tampoco"

# (weight, pattern): elements in order; UPPER CASE is a class, lower case a choice of words; "..n" lets up to n other words stand between; "^" is the clause's begin and "$" its end.
PATTERNS: list[tuple[float, str]] = [
    # insults
    (0.9, "SLUR INSULT"),
    (0.8, "SLUR ..1 INSULT"),
    (0.8, "INSULT SLUR"),
    (0.9, "you|your|youre|du|tu|ihr|sois|eres|vous|hey ..2 INSULT"),
    (0.9, "PERSON ..5 is|are|was|were|est|sont|ist|sind|es|son|must|be|being ..6 INSULT"),
    (0.9, "PERSON ..4 : INSULT"),
    (0.7, "PERSON ..3 , ..1 quel|quelle|une|un|what ..2 INSULT"),
    (0.9, "only|nur|solo|seul|seule ..1 a|an|ein|eine|un|une ..2 INSULT ..1 would|lobt|pone|mettrait|met|wurde"),
    (0.8, "just|such|what ..1 a|an ..1 INSULT $"),
    (0.8, "so ein|eine|einen ..1 INSULT"),
    (0.8, "dieses|diese|dieser|du ..2 INSULT"),
    (0.8, "bande|espece|bunch|pack|tas ..0 d|de|of ..2 INSULT"),
    (0.8, "quel|quelle ..1 INSULT"),
    (0.8, "^ INSULT $"),
    (0.8, "^ INSULT ..1 every|all|alle|tous|todos"),
    (0.8, "take ..1 other INSULT"),
    (0.8, "a PERSON|owner ..1 INSULT"),
    (0.7, "told ..3 INSULT ..1 to"),
    (0.8, "PERSON ..3 est|ist|es ..1 un|une|ein|eine|una ..2 INSULT"),
    (0.7, "encore ..1 un|une ..1 INSULT"),
    (0.8, "ihr|ihre INSULT"),
    (0.8, "ce|cette|cet|ese|esa|esos|that|this|these|those INSULT $"),
    (0.7, "bunch|pack of ..2 INSULT"),
    (0.9, "shut|shutup your|ur mouth|face|trap"),
    (0.9, "ferme|fermez ta|votre gueule"), (0.9, "ta gueule"), (0.9, "halt|haltet die|deine|eure fresse|klappe|schnauze|maul"), (0.9, "callate|callaos , ..1 INSULT"), (0.9, "cierra la boca"),
    (0.9, "pedazo|montones|panda|hatajo|cacho de ..1 INSULT"), (0.8, "menudo|menuda|vaya|menudos|menudas ..1 INSULT"), (0.9, "mehr verstand|hirn|grips als ..1 dieser|diese|du|ihr|der|die|PERSON"), (0.9, "mas luces|cerebro|inteligencia que ..2 PERSON|ese|esa"), (0.9, "plus de cervelle|jugeote|cerveau que ..2 PERSON"), (0.9, "more brains|sense than ..2 PERSON"),
    (0.9, "get lost ..3 INSULT"), (0.9, "fuck you|off|u|your"), (0.9, "va te faire"), (0.9, "vete a la mierda"), (0.9, "fick dich"), (0.8, "leck mich"),
    (0.8, "staff|they|you|people|agents|clerks|women|men are ..1 INSULT"),
    (0.8, "old|dumb|young|these|those INSULT shouldn|should|must|can"),
    # someone compared with things: brighter things, stones, animals than this person
    (0.9, "smarter|brighter|cleverer|wiser|kluger|schlauer|klugere|schlauere ..9 than|als|que ..2 PERSON|this|that|dieser|diese|der|die"), (0.9, "plus|mas intelligents|intelligent|intelligentes|inteligentes|inteligente|listas|listos|listo|malins|malin ..3 que ..2 PERSON|ce|cette|ces|ese|esa|este|esta"),
    (0.9, "smarter|brighter|cleverer things|stones|bricks|rocks|dogs ..4 scraped|stepped|kicked|seen|met|picked"), (0.9, "klugere|schlauere|kluger|schlauer ..1 steine|dinge|hunde"), (0.9, "steine|hunde ..3 kluger|schlauer"), (0.9, "piedras|perros mas listas|listos|inteligentes"), (0.9, "mas listas|listos|inteligentes ..2 piedras|perros"), (0.9, "cailloux|pierres|chiens plus intelligents|malins"),
    (0.9, "people|gens|leute|gente like|comme|wie|como you|toi|vous|dich|tu|ihr ..3 reason|raison|grund|razon"), (0.9, "parents ..1 regret ..1 having"), (0.9, "nobody|noone would|will|d miss you|him|her|them"), (0.9, "never ..1 have been born"), (0.9, "talk|speak to you|them|him|her like toddlers|children|animals|dogs"),
    (0.8, "PERSON ..6 mother|father|parents should be ashamed"), (0.8, "mutter|eltern sollte|sollten sich schamen"),
    # threats
    (0.9, "PERSON ..4 HARM"), (0.9, "INSULT ..6 HARM"), (0.9, "GROUP ..5 HARM"), (0.9, "HARM ..3 INSULT"), (0.8, "soll|sollen|sollt|should|can|may|hope|ojala|devrait|devraient|peut|peuvent|tendria|tendrian|deberia|deberian ..6 HARM"),
    (0.8, "ojala ..2 HARM"), (0.8, "^ go ..1 HARM"), (0.7, "^ HARM $"), (0.8, "INSULT ..8 burn|die $"), (0.9, "should|hope|all ..3 burn|die $"), (0.9, "hope ..3 all burn|die|HARM"), (0.9, "GROUP ..2 all burn|die"), (0.9, "should burn ..2 and take"), (0.9, "should burn , ..1 and ..2 take"),
    (0.9, "know where you live"), (0.9, "sais ou tu habites"), (0.9, "sais ou vous habitez"), (0.9, "se donde vives"), (0.9, "weiss wo du wohnst"), (0.9, "weiss , wo du wohnst"), (0.9, "burn|burns down ..1 with you"), (0.9, "FUTURE ..3 VIOLENT ..2 you|u|him|her|them|your|dich|euch|ihn|te|os|vous|lo|la"), (0.9, "FUTURE ..1 find|get|come you|for ..3 and|VIOLENT"), (0.9, "te|os|le|lo|vous ..2 FUTURE ..2 VIOLENT"), (0.9, "WISH ..4 PERSON|GROUP|all ..4 ILL|HARM"), (0.9, "werde|werden dich|euch|ihn|sie ..3 VIOLENT"), (0.9, "know|found where you work|sleep|park"),
    (0.9, "wait|waiting for ..3 after closing|work|dark"), (0.9, "teach him|her|them ..1 not to"), (0.9, "ever see|meet ..4 again ..3 won"), (0.9, "watch your back"), (0.9, "favour|favor and stop breathing"), (0.9, "yes you ..6 HARM"), (0.9, "yes you ..8 burn|die"),
    (0.9, "pass auf ..3 nach hause"), (0.9, "komme vorbei und"), (0.8, "te|os|le voy a partir|romper|matar"), (0.8, "te|vous vais casser|tuer|demolir|defoncer"),
    # groups
    (0.9, "GROUP ..3 INSULT"), (0.9, "GROUP ..6 nothing but ..2 INSULT"), (0.9, "GROUP ..3 is|are|re|sont|sind|son ..3 CRIME"), (0.9, "GROUP , ..3 CRIME"), (0.9, "CRIME born"), (0.9, "born CRIME|SLUR|INSULT"), (0.9, "CRIME nes|nees"), (0.9, "geborene|geborenen CRIME"), (0.9, "CRIME de nacimiento"),
    (0.9, "they|he|she are|re|is|all ..1 born ..2 CRIME|SLUR|INSULT"), (0.8, "typisch|typical|tipico|typique ..4 GROUP ..6 INSULT|CRIME"),
    (0.9, "GROUP ..8 should|must|need|deserve|deserves|ought|belong ..2 be|get|to ..1 EXPEL"), (0.9, "GROUP ..8 EXPEL ..1 them|back|out|away"), (0.9, "EXPEL ..1 them|GROUP ..3 back|out|away|home|before"), (0.9, "EXPEL back ..3 crates|boxes|where|home"), (0.9, "qu on les|vous EXPEL"), (0.9, "que los|las EXPEL"), (0.9, "gehoren ..3 EXPEL"), (0.9, "devraient|devrait etre EXPEL"), (0.9, "deberian|hay que EXPEL"),
    (0.9, "GROUP ..6 belong|belongs ..3 kitchen|stove|zoo|cage"), (0.9, "GROUP ..4 gehoren|gehort ..1 an den herd"), (0.9, "gehoren|gehort an den herd"), (0.9, "retournez|retourne a vos|tes casseroles|fourneaux"), (0.9, "vuelvan|vuelve|volved a la|vuestra|su cocina"), (0.9, "GROUP ..6 a fregar"), (0.9, "a fregar"),
    (0.9, "GROUP ..3 no business living|being|working"), (0.9, "no business living among|near us"), (0.9, "GROUP ..8 don|doesn|not|never ..1 deserve"), (0.9, "keep them|GROUP away from ..1 decent|honest|normal"), (0.9, "GROUP|INSULT ..2 shouldn|should ..2 be allowed to"), (0.9, "GROUP ..8 not|never be|get served|hired|trusted|allowed"),
    (0.9, "never let a GROUP ..2 touch"), (0.9, "never let a ..3 touch ..6 born"), (0.8, "GROUP ..3 ruin every"), (0.9, "rien a attendre des GROUP"),
    # explicit content
    (0.9, "STRONG ..8 EXPLICIT"), (0.9, "EXPLICIT ..8 STRONG"), (0.9, "so horny|geil ..4"), (0.9, "geil|scharf auf dich|euch|sie"), (0.9, "looking for sex ..1 tonight|now|here"), (0.9, "do you all night"), (0.9, "jerk|jerking off"), (0.9, "send|sent|schick|schickte|envoie|envoye|mando|manda|manda ..4 nudes|nacktfotos|nacktbilder|nue|desnuda|nackt|nude"),
    (0.9, "envie ..1 de ..2 STRONG"), (0.9, "quiero STRONG"), (0.9, "EXPLICIT ..3 girls|boys|men|women ..3 message"), (0.9, "busco|cherche|suche ..2 sexo|sexe|sex"), (0.9, "sexo|sexe esta|ce|cette ..1 noche|soir|nuit"), (0.9, "photos|fotos|pics|pictures ..1 nue|nues|desnuda|desnudas|nackt ..6 STRONG|EXPLICIT|envie|quiero"),
]
