"""The grammar of abusive language: word classes, context rules and weighted clause patterns.

A lexicon of general language in English, German, French and Spanish, with the commonest words of some others; classes
are written in capitals in patterns (see ``transducers``).  Groups of people are known by a short list and else by the
structure of the clause ("all X are <degrading noun>"); things and animals in that place are kept out.
"""

from __future__ import annotations

#: Word classes; words in small letters without accents.  Nouns, adjectives and verbs are inflected by ``inflected``.
LEXICON = {
    # Pronouns and function words.
    "YOU": "you u ya ye yourself yourselves youre du dich dir euch ihr tu te toi vous ti vos usted ustedes tus ты тебя тебе вас voce jou",
    "YOUR": "your ur yours dein deine deinen deiner deinem eure ta ton tes votre vos tu tus tua tuo teu sua twoja твой твоя твою",
    "I": "i we ich wir je j yo nosotros io eu ik я мы im ive ill",
    "ME": "me us mich mir uns moi m nous mi myself",
    "MY": "my our mein meine meinen unser unsere mon ma mes notre nos mi mis nuestro nuestra",
    "HESHE": "he she him er sie il elle lui el ella he's she's",
    "THEY": "they them these those theyre sie ils elles eux ellos ellas esos estas estos esas ces diese",
    "HIS": "his her hers their theirs sein seine ihre son sa ses leur leurs",
    "BE": "is are was were am be been being r s re ist sind bin bist war waren seid est sont suis es etes etait sois eres son soy sos fue "
    "e sei siete sono sao ben bent zijn jest",
    "FUT": "will would shall gonna going to ll could might must want wanna swear promise need may can werde will vais va allons voy "
    "vamos quiero should d zal ga",
    "DET": "a an the ein eine einen einer eines un une uno una unos unas el la le les l los las des du der die das den dem il lo gli "
    "um uma o os een de d this that any some every each no",
    "ADV": "just only really such so total totally complete completely absolute absolutely utter utterly fucking fuckin bloody goddamn damn "
    "damned freaking frigging all nothing but always very too even still clearly obviously truly pure real huge big little old bunch of lot "
    "pack most more worst both bloody vraiment tan muy ganz echt so richtig completo completa totalement tellement trop gros grosse petit petite "
    "verdammter verdammte verdammt pinche puto puta always forever never again slowly personally honestly probably simply",
    "NOT": "not never no isnt arent wasnt dont doesnt didnt wont wouldnt cant couldnt neither nor without kein keine keinen nicht pas jamais "
    "ningun nunca hardly",
    "AND": "and or und et y e plus",
    "SAY": "call calls called calling say says said saying term terms word words phrase insult insults slur slurs quote quotes quoted quoting "
    "mean means meaning define defines definition etymology translate translates translation spell spelled rule rules forbid forbids "
    "nannte nennen nennt genannt wort appeler appelle traiter traite mot llamar llama llamo palabra label labels labelled shout shouting using use used like",
    "QUOTED": "insult insults slur slurs word words banned forbidden offensive allowed derogatory term terms swearword swearwords expletive "
    "profanity abuse rude",
    "OTHERS": "he she they him her them someone somebody anyone anybody nobody people who everyone users members",
    # People, by whom insults may be aimed at.
    "PERSON": "man men woman women girl girls boy boys guy guys person people human humans kid kids child children bloke dude lad lady ladies "
    "mother father mom mum mama dad brother sister wife husband son daughter boss neighbour neighbor neighbours neighbors admin admins mod mods "
    "moderator moderators landlord teacher driver creature individual family mensch kerl typ frau mann mere pere femme homme type mec hombre mujer tipo tio "
    "madre padre ex colleague coworker manager op poster",
    "PARTNER": "girl girls woman women housewife housewives wife wives amateur amateurs teen teens babe babes lady ladies chick chicks mom moms "
    "mum mums singles couples sluts filles fille femmes femme chicas chica mujeres mujer frauen frau madchen ragazze ragazza boys men guys mature matures",
    # Insults.
    "BADNOUN": "idiot moron imbecile cretin halfwit dumbass bastard scumbag loser asshole arsehole bitch whore slut cunt dickhead prick twat wanker "
    "retard dimwit nitwit numbskull numskull dipshit shithead fuckface motherfucker fucker douchebag douche jackass dumbfuck lowlife degenerate "
    "pervert simpleton bonehead airhead blockhead knucklehead buffoon dunce dolt tosser bellend knobhead dullard ignoramus shitbag asshat asswipe "
    "dirtbag sleazebag crybaby halfbrain pillock muppet plonker numpty ingrate scoundrel nutjob creep weirdo psycho coward "
    "hypocrite fool oaf thickhead git minger hag crone trollop floozy harlot slag slapper spaz dork dweeb doofus schmuck putz twit prat berk arsewipe dunderhead clod lout boor lunatic nutcase psychopath sociopath sissy wimp pansy wuss bum leper tramp tosspot bollockhead pissant shitstain skank hoe thot cocksucker cuck incel freak",
    "BADNOUNS": "vollidiot vollidioten idioten penner drecksack drecksau arschloch arschlocher hurensohn hurensohne wichser missgeburt fotze schlampe hure trottel "
    "depp deppen spast spasti mistkerl schwachkopf dummkopf versager nutte dreckskerl volltrottel vollpfosten saftsack hackfresse schweinehund flachzange weichei dreckschwein dumpfbacke vollhonk bastard idiot affe miststuck pissnelke arsch "
    "ordure connard connards connasse conne abruti abrutis abrutie debile debiles salope salopes salaud salauds encule encules batard batards raclure cretine pourriture "
    "minable minables enfoire enfoires trouduc petasse pouffiasse cretin cretins imbecile imbeciles couillon clochard idiote crapule pute putes fumier tocard bouffon bouffonne crevard "
    "inutil inutiles imbecil imbeciles idiota idiotas desgraciado desgraciada desgraciados gilipollas puto puta putas cabron cabrones pendejo pendejos pendeja estupido estupida "
    "subnormal zorra maricon malnacido malnacida tarado tarada hijoputa capullo payaso baboso culero cretino cretina cerdo imbecila pajero soplapollas tarado tarada huevon boludo pelotudo pelotuda mamon "
    "stronzo stronza coglione coglioni puttana bastardo cretino deficiente scemo babbeo otario otaria babaca burro arrombado vagabunda klootzak eikel sukkel trut "
    "kurwa debil idiota сука блядь мудак придурок дебил тварь урод скотина ублюдок",
    "BADANIMAL": "pig parasite rat animal clown cow dog snake worm maggot cockroach leech toad weasel vulture swine schwein hund sau "
    "porc chien chienne truie cerdo cerda perro perra rata vieh ungeheuer monster monstre disgrace joke embarrassment failure nobody tool",
    "TRASH": "shit crap dreck trash garbage scheisse merde mierda basura rubbish filth dirt junk dog mist merda",
    "BADADJ": "stupid worthless useless pathetic brainless braindead spineless disgusting filthy dumb moronic idiotic ugly miserable retarded "
    "despicable revolting gutless clueless lousy rotten vile repulsive ignorant inept incompetent cowardly loathsome "
    "wretched daft gormless contemptible obnoxious putrid pitiful brain-dead lazy fat smelly stinking slimy greasy hideous demented deranged delusional insufferable sick",
    "BADADJS": "hirnlos dumm strohdumm dreckig widerlich wertlos erbarmlich nutzlos hasslich bescheuert bekloppt behindert feige ekelhaft "
    "minable nul nulle stupide bete debile degueulasse moche inutile pathetique immonde con "
    "asqueroso asquerosa maldito maldita sucio sucia patetico patetica tonto tonta feo fea estupido estupida inutil despreciable repugnante",
    "SLUR": "nigger faggot kike wetback raghead untermensch chink gook spic paki towelhead tranny dyke fag nigga darkie kanake bougnoule "
    "youpin sudaca maricones",
    # Violence.
    "KILL": "kill murder strangle stab slaughter behead gut cripple rape torture execute butcher decapitate mutilate disembowel "
    "exterminate lynch maim suffocate",
    "HURT": "break smash snap crush shoot beat punch hurt slap cut slit choke burn skin bash rip knock drown hang shove hit kick whip stomp "
    "wreck destroy bury pound thrash batter carve poison run gouge twist pull tear throw bust end finish stick strip",
    "HURTS": "schlag schlage schlagen brech breche brechen hau haue hauen stech steche stechen abstechen erschiess erschiesse erschiessen umbringen bring "
    "verprugel verprugeln tote toten erwurge erwurgen polier reiss zerquetsche "
    "casse casser casserai brise briser briserai tue tuer tuerai frappe frapper peter pete cogner defoncer defonce eclater eclate exploser egorger etrangler creve "
    "buter bute planter brule bruler noyer pendre demolir massacrer "
    "romper rompo partir parto matar mato reventar reviento golpear rajar rajo quebrar degollar ahogar apunalar quemar cortar romperte partirte matarte "
    "reventarte ammazzo uccido spacco matarei",
    "BODY": "tooth teeth leg legs knee knees kneecap kneecaps rib ribs neck jaw nose finger fingers skull face bone bones head throat arm arms gut guts "
    "eye eyes hand hands spine ass arse balls brain brains skin heart tongue back windpipe ankles toes "
    "zahne zahn knochen beine bein nase fresse gesicht schadel hals arme finger maul "
    "figure gueule genou genoux jambe jambes dents tete bras os nez gorge doigts "
    "cara pierna piernas dientes hueso huesos boca cabeza cuello brazo brazos rodillas cuello alma faccia gambe",
    "WEAPON": "bullet knife blade axe bat brick fist hammer bottle noose rope gun shotgun rifle acid boot",
    "HOME": "house home flat apartment car place shop store office mosque synagogue church boat haus wohnung auto maison voiture casa coche piso village camp",
    "DIE": "die dies died dead choke chokes suffer suffers rot rots drown drowns burn burns bleed bleeds crash perish starve sterben verrecken verreckst verreck "
    "krepieren krepierst krepier stirb stirbst ersaufen crever creves creve meurs mourir crevez morir mueras muere muerete mueran pudras pudrete pudran "
    "ahogues atropelle atropellen caigas revientes schiatta crepa",
    "HOPE": "hope wish pray hoffe hoffentlich wunsche espere esperons souhaite ojala espero spero",
    # Groups and what they are degraded to.
    "GROUP": "foreigner newcomer immigrant migrant refugee jew muslim black gay lesbian arab gypsy christian asian mexican african indian homosexual tranny "
    "trans atheist catholic hindu turk russian chinese jewish polish turkish romani roma gays islamic white women poles auslander fluchtlinge juden frauen "
    "zigeuner turken polen schwarze schwule moslems asylanten "
    "etrangers immigres juifs femmes arabes noirs musulmans gitans homosexuels extranjeros inmigrantes judios mujeres gitanos moros negros musulmanes homosexuales "
    "native southerner northerner islander outsider settler poor disabled",
    "FOLK": "people folk folks family families men tribe race lot kind sort breed community leute volk gens gente pack",
    "SCUM": "scum subhuman gesindel ungeziefer untermensch untermenschen abschaum pack racaille vermine escoria gentuza chusma sottouomini feccia scoria",
    "PEST": "vermin lice plague rat cockroach roach leech maggot parasite pest ape monkey savage animal pig dog swine cancer disease filth garbage "
    "trash dirt infestation ratten parasiten lause schweine tiere pest krebs abfall mull rats parasites cafards animaux betes cancer peste "
    "ratas plaga parasitos animales cerdos basura bestias cucarachas",
    "CRIM": "thief thieves liar criminal rapist murderer terrorist crook cheat scrounger beggar barbarian pedophile paedophile degenerate "
    "diebe verbrecher lugner betruger kriminelle morder voleurs menteurs criminels violeurs assassins ladrones mentirosos criminales violadores asesinos delincuentes",
    "REEK": "stink stinks stank stinken stinkt stunk smell smells steal steals lie lies rape rapes breed reek reeks klauen klaut lugen betrugen puent volent mentent violent apestan roban "
    "mienten huelen ruin ruins infest invade invades pollute destroy stole lied cheat",
    "PRON": "it this that he she i we you ich wir je er sie il elle yo who which what there here and or but",
    "THING": "cat dog rat mouse mice slug snail weed ant wasp mosquito fly flies fox seagull gull pigeon beetle aphid bird fish wolf cow horse sheep goat "
    "moth tick flea rabbit deer crow plant seed bug bugs file files process battery cable menu code server driver weather price cost "
    "virus spam bot bots robot rodent squirrel hornet termite locust jellyfish crab kitten puppy whale bear bears monkeys apes "
    "nettle bramble bindweed knotweed mice pests ads popups mushroom algae goose geese tide report figure number result game",
    "EXPEL": "deport expel gas sterilise sterilize exterminate eradicate eliminate purge vergasen vergast rausgeworfen rauswerfen abschieben abgeschoben erschossen "
    "aufgehangt ausrotten vertreiben chasser virer eliminer expulser exterminer gazer echar echarlos expulsar expulsarlos eliminarlos matarlos exterminarlos gasear",
    # Sex.
    "LEWD": "blowjob handjob cumshot gangbang threesome deepthroat creampie milf camgirl horny nudes titties follada hentai onlyfans schwanzlutscher cunnilingus "
    "fellatio rimjob bukkake facesitting xxx jizz cumming fap fapping upskirt boobies dildo dildos cameltoe bareback gloryhole",
    "PORN": "porn porno pornos pornography pornographic smut pornovideos erotik",
    "PARTS": "tits boobs pussy cock dick penis vagina clit nipples cunt schwanz muschi titten mose bite chatte nichons polla tetas cono verga culo teta",
    "NUDE": "naked nude nudes topless undressed unclothed nackt nackte nackten nackter nue nues nus desnuda desnudas desnudo nua nude nuda",
    "FUCK": "fuck fucks fucked fucking fuckin shag bang screw ficken fick ficke gefickt vogeln bumsen baiser baise niquer enculer sauter follar follarte cogerte coger "
    "joder jodan fottere scopare foder fode neuken trahaть",
    "SEX": "sex sexo sexe sesso geschlechtsverkehr intercourse",
    "PHOTO": "photo photos pic pics picture pictures clip clips video videos selfie selfies cam cams webcam bilder foto fotos images film films movie movies "
    "gallery set livecam scenes tape",
    "HOT": "hot horny sexy geil geile geiler geilen heisse heiss chaude chaudes chaud caliente calientes hardcore kinky wet naughty willing steamy slutty",
    "NIGHT": "tonight night now heute ce soir nuit nacht ganze noche esta toda notte area near nearby",
    # Uses that aren't abuse: study, rules and health; games; compounds.
    "STUDY": "study studies research paper disorder disorders addiction filter filters policy treatment education health clinical therapy medical law laws "
    "legal statistics history exhibition museum painting sculpture statue medicine doctor hospital prevention awareness survey documentary lexicon dictionary "
    "biology species anatomy patients treatable symptoms syndrome cancer screening biopsy literature novel portrait renaissance",
    "BIRD": "blue great coal marsh willow crested bird birds feeder nest garden common species",
    "PLAYED": "chess checkers poker cards tennis quiz race game games match round level tournament trivia score record rank league time deal price losses hill "
    "argument debate scrabble football arena multiplayer boss fight raid",
    "COMPOUND": "file files sword title wing amber rip saw stitch light lights board proof mode box button guide sheet filter iron tail house pen sprite tape gasket "
    "terminal terminals waiter phone luck question questions mistake weather idea server variable code script machine screen button model version move joke error mail "
    "names typo fix test design rule rules excuse reason thing things decision reasons plan day week habit interface firmware driver drivers laptop cable",
    "NOTBODY": "rest rests brake plate lights light band piece wear count shot line mesh model rig saw saver gasket board cover strap drill torch tool set pump "
    "shield bar phones phone office door seat lash brace guard record rope post cream lotion wash massage exercises",
    "SENT": "message messages mail email line text pm dm note reply photo link copy screenshot",
    "GENERIC": "file files process processes server job jobs thread threads task tasks zombie session connection daemon app weeds aphids slugs bugs",
}

#: Classes whose English words are inflected: nouns get plurals, verbs their endings.
NOUNS = ("BADNOUN", "BADANIMAL", "SLUR", "GROUP", "PEST", "CRIM", "THING")
VERBS = ("KILL", "HURT", "EXPEL")
ADJECTIVES, ENDINGS = ("BADADJ", "BADADJS"), ("BADADJS",)
#: Classes that disguises are undone for.
DISGUISED = (
    "BADNOUN", "BADNOUNS", "BADANIMAL", "BADADJ", "BADADJS", "SLUR", "SCUM", "PEST", "CRIM", "LEWD", "PORN", "PARTS", "NUDE", "FUCK", "KILL", "HURT",
    "TRASH", "HOT", "GROUP", "BODY", "DIE", "SEX", "YOU", "EXPEL",
)
#: Entries of several words that a mask may hide whole.
MASKED_PHRASES = {"piece of shit": "BADNOUN", "piece of garbage": "BADNOUN", "piece of crap": "BADNOUN", "son of a bitch": "BADNOUN"}
#: Ordinary words that would be read as drawn-out or coded ones.
ORDINARY = (
    "looser loosers rapped rapping rapper rappers coop boot root roots asses beet beets butt bull boob cooks kool poof diss dummy "
    "bass mass hiss whoops hott toot hoot loot bee been seen feed need week peep shooot aass pusses cocks boons ratt rats dogg "
    "hangar ass4 60 80 1 2 3 4 5 6 7 8 9 0 too off see all well tall tell less miss coon wooden dutty slapp sitt hiitt hello will "
    "shoot shoots foot feet good book look took door poor soon moon noon tool tools school pool cool wool fool fools roof proof"
)

#: Named parts of patterns.
MACROS = {
    "BAD": "BADADJ | BADADJS",
    "FILL": "DET | ADV | <BAD>",
    "INSULT": "BADNOUN | BADNOUNS | ( piece | pieces | stuck | haufen | pedazo | trozo | bout | tas | sack | load | pile ) ( of | de | BE )? ADV? TRASH "
    "| waste of ( oxygen | space | air | skin | breath | life ) | ( son | hijo | hija | fils ) ( of | de ) DET? ( BADNOUN | BADNOUNS )",
    "VILE": "<INSULT> | BADANIMAL | TRASH",
    "IS": "BE | look | looks | looked | sound | sounds | seem | seems | smell | smells",
    "HIM": "YOU | HESHE | THEY | PERSON | him | her | them",
    "WHO": "YOU | HESHE | THEY | PERSON",
    "DIE": "die | drop dead | rot | burn | sterben | crever | morir",
    "SHE": "her | him | ME | YOU | them | PARTNER",
    "ALL": "all | every | alle | jeder | todos | tous | these | those | diese | esos | ces | any | the | les | los | die | most | always | these",
    "DEGRADED": "SCUM | PEST | CRIM | BADNOUN | BADNOUNS",
    "LOT": "them all | all of them | the lot | the whole lot | every one of them | every last one | the bunch | them",
}

#: Context rules (component, left context, classes taken off, right context).
CONTEXTS = [
    ("negation", "NOT ( DET | ADV!NOT | BE | BADADJ | to | be | being ){0,4}", "BADNOUN BADNOUNS BADANIMAL BADADJ BADADJS TRASH", ""),
    ("negation", "NOT ( ADV | . ){0,1}", "KILL HURT HURTS", ""),
    ("negation", "( NOT | never | dont | hardly ) ( ADV | . ){0,3}", "PEST CRIM SCUM", ""),
    ("reported", "SAY ( .!YOU!BADNOUN ){0,4}", "BADNOUN BADNOUNS BADANIMAL BADADJ BADADJS SLUR SCUM PEST CRIM", ""),
    ("reported", "SAY ( .!YOU!BADNOUN ){0,3} ( BADNOUN | BADNOUNS | BADADJ | SLUR ) ( COMMA | AND )", "BADNOUN BADNOUNS BADADJ SLUR", ""),
    ("reported", "OTHERS ( .!I ){0,2} SAY YOU .{0,3}", "BADNOUN BADNOUNS BADANIMAL BADADJ BADADJS SLUR", ""),
    ("reported", "", "BADNOUN BADNOUNS SLUR BADADJ BADADJS", "( BE | counts | gets | as ){1,3} ( DET | ADV | NOT ){0,2} ( QUOTED | SAY )"),
    ("self", "( I | I BE | I felt | I feel | felt | feeling | I look | I looked | I must ) ( BE | have | been | like | ADV | DET | <BAD> ){0,5}",
     "BADNOUN BADNOUNS BADANIMAL BADADJ BADADJS TRASH", ""),
    ("self", "SAY ME ( DET | ADV | BADADJ ){0,3}", "BADNOUN BADNOUNS BADADJ BADADJS", ""),
    ("self", "", "BADADJ BADADJS", "( old )? ME ( $ | COMMA | . )"),
    ("self", "MY ( own )?", "BADADJ BADADJS", ""),
    ("self", "( myself | ourselves ) .{0,2}", "BADNOUN BADADJ", ""),
    ("technical", "", "BADNOUN BADNOUNS BADANIMAL BADADJ BADADJS", "COMPOUND"),
    ("technical", "( ^ | COMMA | .!YOU!BADADJ )", "BADADJ BADADJS", "( but | COMMA )? DET? THING"),
    ("technical", "", "BODY", "NOTBODY"),
    ("technical", "( STUDY ~{0,6} )", "PORN PARTS NUDE SEX LEWD FUCK", ""),
    ("technical", "", "PORN PARTS NUDE SEX LEWD FUCK", "~{0,6} STUDY"),
    ("technical", "BIRD .{0,2}", "PARTS", ""),
    ("technical", "", "PARTS", ".{0,4} BIRD"),
    ("technical", "( food | earth | gear | map | desk | ruin | cable | space | book | bike | kit | tool | data | word | weather | car | house )", "PORN", ""),
    ("technical", "", "NUDE", "( eye | eyes | mole | flame | bulb | wire | wires | short | option | options | truth | aggression | lipstick | colour | color | beach | dsl | root | roots )"),
    ("figurative", "", "KILL HURT", "( YOU | ME ) DET .{0,2} SENT"),
    ("figurative", "", "KILL HURT", "YOU ( at | in | on | by | to | with a | over ) .{0,4} PLAYED"),
    ("figurative", "", "KILL HURT", "YOU to ( it | the | DET )"),
    ("figurative", "", "HURT KILL", "YOUR ( own )? .{0,1} ( hair | nails | PLAYED | GENERIC | losses | grass | lawn | bill | bills | costs | darlings | bread | cake )"),
    ("figurative", "YOU ( FUT | ADV | AND ){0,3}", "HURT KILL", "YOUR .{0,1} BODY"),
    ("figurative", "", "DIE HURT", "the ( .!DIE )"),
    ("figurative", "", "HURT", "YOU ( some | a | an | up a | out a | in on | off a ) "),
    ("figurative", "", "HURT KILL", "( DET | the | YOUR ) ADV? GENERIC"),
    ("figurative", "THING ( .!AND ){0,3} ( BE | FUT )? ( BE | ADV ){0,2}", "PEST", ""),
]

#: Weights: STRONG alone makes a clause abusive, FAIR needs more, SOME is a hint.
STRONG, FAIR, SOME = 1.3, 0.8, 0.5

#: Weighted clause patterns (kind, weight, pattern).
PATTERNS = [
    # Insults: to the second person, of a person, by address.
    ("insult", STRONG, "YOU ( <FILL> | COMMA | BE | AND | little | fat | old | for | like ){0,6} ( BADNOUN | BADNOUNS )"),
    ("insult", STRONG, "YOU ( BE | ADV | DET | would | will | have | must | been | such | little | COMMA ){0,5} <BAD>+ ( COMMA | AND | <BAD> | ADV ){0,3} ( <VILE> | PERSON | creature | thing | GROUP )"),
    ("insult", STRONG, "YOU ( BE | re ) ( ADV | DET | as | so ){0,3} <BAD> ( $ | COMMA | AND | to | as | you | YOU | that | beyond )"),
    ("insult", STRONG, "YOU ( BE | are ) ( ADV | DET | like | such ){0,4} <BAD>* ( BADANIMAL | TRASH ) ( $ | COMMA | AND | !COMPOUND )"),
    ("insult", STRONG, "YOU ( BE )? ( ADV | DET ){0,3} <INSULT>"),
    ("insult", STRONG, "( eres | sos | sois | sei | siete | jestes | bist ) ( ADV | DET | COMMA ){0,4} <BAD>* ( <VILE> | <BAD> )"),
    ("insult", STRONG, "( <WHO> | who ) ( !I!THING!PRON ){0,1} BE ( ADV!NOT | DET | like | such ){0,5} <BAD>* ( .!NOT!SAY ){0,1} ( BADNOUN | BADNOUNS | waste of . )"),
    ("insult", STRONG, "( <WHO> ) BE ( ADV | DET ){0,3} <BAD> AND? <BAD>* ( <VILE> | PERSON )"),
    ("insult", STRONG, "( what | such | que | quel | quelle | so | was fur ) DET? ADV{0,2} <BAD>+ ( <VILE> | PERSON )"),
    ("insult", STRONG, "( what | quel | quelle | menudo | menuda | que ) DET? ADV{0,2} <INSULT>"),
    ("insult", STRONG, "<BAD> ( COMMA | AND )? <BAD>* <INSULT>"),
    ("insult", STRONG, "<BAD> ( COMMA | AND )? <BAD>+ ( BADANIMAL | TRASH )"),
    ("insult", FAIR, "<BAD> BADANIMAL"),
    ("insult", FAIR, "( such | so | another ) DET? <BAD>* <INSULT>"),
    ("insult", STRONG, "( shut up | shut it | get lost | listen | go away | piss off | bugger off | hey | oi | look here | get out | ferme la | tais toi | callate | sei still | fuck off "
     "| sod off | move | wake up | shame on | screw | damn | stupid ) ( COMMA | YOU | DET | ADV | AND ){0,3} <BAD>* ( <INSULT> | BADANIMAL )"),
    ("insult", STRONG, "( only | solo | nur ) DET <BAD>* ( <VILE> ) ( would | could | can | like | who )"),
    ("insult", STRONG, "( any | every | no ) <BAD>* BADNOUN ( could | can | knows | would )"),
    ("insult", STRONG, "( ban | report | ignore | block | remove | fire | kick | sack | arrest | hate | tell | stop | mute | listen to | shut ) ( up )? ( this | that | these | those | the | such ) ( DET | ADV | local ){0,2} <BAD>* ( <VILE> )"),
    ("insult", STRONG, "( MY | the | this | that ) ( local | resident | usual | village | favourite | own | forum | board ) <BAD>* ( <VILE> )"),
    ("insult", STRONG, "<INSULT> ( like | wie | comme | como ) YOU"),
    ("insult", STRONG, "( espece | bande | tas | sale | pauvre | gros | grosse | petit | petite | pinche | maldito | maldita | jodido | verdammter | verdammte | dreckiger | du | blode | bloder | blodes | fucking ) ( de | d | DET )? ( COMMA )? <BAD>* ( BADNOUN | BADNOUNS | BADANIMAL | TRASH )"),
    ("insult", STRONG, "( BADNOUN | BADNOUNS | BADANIMAL | TRASH ) ( de | of | der ) ( TRASH | la chingada )"),
    ("insult", STRONG, "^ ( DET | ADV | COMMA | oh | lol | wow | well | hey | ok | please | haha | go | AND ){0,3} <BAD>* ( BADNOUN | BADNOUNS ) $"),
    ("insult", FAIR, "^ ( oh | lol | wow | well | seriously | ok | please | hey | haha | COMMA | AND ){0,3} <BAD>* <INSULT> ( COMMA | $ )"),
    ("insult", FAIR, "( COMMA | YOU | to | it | off | up | here | go | back ) <BAD>* ( BADNOUN | BADNOUNS ) ( $ | COMMA )"),
    ("insult", STRONG, "COMMA ( YOU | DET? real | DET? total | DET? complete )? <BAD>* ( BADNOUN | BADNOUNS ) $"),
    ("insult", STRONG, "YOU ( PERSON | FOLK | GROUP | all | lot | guys | ones ) ( BE | ADV ){1,2} ( ADV | DET ){0,3} ( <BAD> | <VILE> )"),
    ("insult", STRONG, "( who | whoever | anyone | anybody | everyone | everybody | wer | quien | celui ) ( .!I!SAY ){1,6} BE ( ADV!NOT | DET ){0,4} <BAD>* ( BADNOUN | BADNOUNS )"),
    ("insult", STRONG, "<WHO> BE DET .{1,2} AND DET ( ADV | <BAD> )* ( BADNOUN | BADNOUNS )"),
    ("insult", STRONG, "<BAD> excuse for | ( son | hijo | hija | fils ) ( of | de ) DET? ( BADNOUN | BADNOUNS )"),
    ("insult", SOME, "( another | usual | yet another | more ) <BAD> ( post | comment | answer | reply | thread | rant )"),
    ("insult", SOME, "( post | comment | rant | reply ) ( from | by ) MY"),
    ("insult", STRONG, "brain ( that | so | as | this | which BE | BE ) <BAD>"),
    ("insult", STRONG, "( YOU | YOUR | HESHE ) .{0,3} ( no | without | half a | half | peanut | pea ) ( brain | brains | braincell | braincells | spine )"),
    ("insult", STRONG, "YOUR ( .!COMPOUND ){0,2} ( BE | so ) ( ADV | DET ){0,3} ( <BAD> | <INSULT> ) ( $ | COMMA | AND )"),
    ("insult", STRONG, "YOUR ( mother | mom | mum | mama | sister | wife | madre | mere | mutter | mama ) ( BE | . ){0,3} ( BADNOUN | BADNOUNS | BADANIMAL )"),
    ("insult", SOME, "surprised ( YOU | HESHE ) can ( breathe | walk | read | type | tie )"),
    ("insult", STRONG, "too <BAD> to ( .!BE )"),
    ("insult", STRONG, "( shove | stick | stuff | ram | cram | put ) .{1,4} up ( YOUR | where ) ( own )? ( ass | arse | hole | butt | BODY | the sun )"),
    ("insult", STRONG, "YOU ( ADV | all | both ){0,2} ( disgust | sicken | repulse ) ME | YOU make ME ( sick | puke | vomit | want to puke ) | ( das | dais | dan ) asco | ME ( degoutes | degoute ) "
     "| YOU widerst ME | YOU kotzt ME an"),
    ("insult", FAIR, "( nobody | noone | no one | everyone | everybody | personne | keiner | nadie ) ( here | ever | really )? ( likes | hates | loves | despises | wants | mag | aime | quiere ) ( DET )? YOU"),
    ("insult", FAIR, "ashamed of ( such | having | YOU | the likes )"),
    ("insult", STRONG, "( shut | close | ferme | cierra | halt | halts | shut up | hou | cala ) ( endlich | einfach | ADV )? ( YOUR | DET ){1,2} ( dumb | stupid | fucking | filthy | ADV )? ( BODY | mouth | face | trap | gob | fresse | klappe | schnauze | maul | gueule | boca | bek | pico )"),
    ("insult", STRONG, "ta gueule | verpiss YOU | verpisst YOU | verpfeif YOU | vete a la ( TRASH | chingada | verga ) | vete al ( carajo | cono ) | va YOU faire ( foutre | enculer | voir ) | que YOU ( jodan | den ) | leck ME | nique YOUR . "
     "| nique sa race | chinga YOUR madre | me cago en YOUR . | vaffanculo | stai zitto | vai tomar no cu | vai YOU foder | spierdalaj | rot op | иди нахуи | пошел нахуи | пошел ты | заткнись | poshel nahui"),
    ("insult", SOME, "degage | callate | shut up | halt die klappe | get lost | raus hier | personne ne veut de YOU | keiner hier | hier keiner | nobody asked ( YOU | for )"),
    ("insult", STRONG, "( fuck | screw | damn ) ( off | YOU | yourself | YOUR . ) | go fuck | fick YOU | fickt YOU | eat shit | suck ( it | my . ) | kiss my ass | up yours"),
    # Wishes of harm.
    ("harm", STRONG, "( ^ | COMMA | AND | go | should | just | please | then | YOU | to | can ) ( KILL | HURT | off | neck | shoot | hang ) ( yourself | yourselves | urself | YOUR self )"),
    ("harm", STRONG, "kys | end YOUR ( own )? ( life | miserable . | pathetic . | worthless . ) | drop dead | dropped dead | go ( AND )? die | drink bleach | eat a bullet | slit YOUR wrists | die in a fire | die already"),
    ("harm", STRONG, "( rot | burn | roast | fry ) in ( DET | ADV )? ( hell | ditch | prison | jail | ground | grave | cell ) | go to hell | straight to hell | go play ( in | on ) ( DET )? ( traffic | motorway | highway | railway ) | fahr zur holle | vete al infierno | va en enfer"),
    ("harm", STRONG, "( crawl | slither | go | creep | get ) back ( in | into | under | to ) YOUR ( .{0,1} ) ( hole | rock | cave | sewer | gutter | swamp | kennel )"),
    ("harm", STRONG, "( ^ | COMMA | go | AND | should | just | please | then | to ) ( .!I ){0,1} jump ( off | from | under | in front of ) DET . "),
    ("harm", STRONG, "HOPE ( that | dass | que | qu | DET ){0,2} ( YOU | HESHE | THEY | YOUR . | PERSON | all of YOU | both of YOU ) ( .!NOT ){0,4} DIE"),
    ("harm", STRONG, "HOPE ( that | DET ){0,2} ( YOU | HESHE | THEY | YOUR . | PERSON | somebody | someone ) ( .!NOT ){0,3} ( KILL | HURT | cancer | aids | run over | hit by )"),
    ("harm", STRONG, "HOPE ( that )? ( .!NOT ){0,4} ( hits | runs | kills | crushes | flattens | bites | eats | HURT | KILL ) YOU"),
    ("harm", STRONG, "( THEY | somebody | someone | I | cops | police ) ( should | ought to | must | need to ) ( ADV | all ){0,2} ( KILL | HURT ) ( people | guys | idiots | folk | folks | types | all ) ( like | of ) YOU"),
    ("harm", STRONG, "ojala ( YOU | os | se ) ( . ){0,3} DIE"),
    ("harm", STRONG, "( nobody | noone | no one | personne | niemand | nadie ) ( would | will | is going to | va a | ne )? ( ADV )? ( miss | mourn | cry for | vermisst | llorar | pleurera | YOU va a llorar ) ( YOU )?"),
    ("harm", STRONG, "YOU ( ADV | all ){0,2} ( should | ought to | deserve to | need to | must ) ( ADV | have | be | been | get | all | just ){0,4} ( DIE | KILL | killed | murdered | stabbed | hanged | shot | beaten | drowned | aborted | put down | castrated | raped | hung | lynched )"),
    ("harm", STRONG, "( HESHE | THEY | PERSON | GROUP | those . | these . ) ( ADV | all ){0,2} ( should | ought to | deserve to | deserves to | must | need to | needs to ) ( ADV | have | be | been | get | all | just ){0,4} ( die | killed | murdered | stabbed | hanged | shot | beaten | drowned | aborted | castrated | raped | hung | lynched | gassed | burned | burnt | rot )"),
    ("harm", STRONG, "( deserve | deserves ) to ( be )? ( die | killed | murdered | stabbed | hanged | shot | beaten | drowned | raped | suffer | burn | rot )"),
    ("harm", STRONG, "should ( have )? ( drowned | aborted | strangled | swallowed | smothered | shot ) YOU"),
    ("harm", STRONG, "( somebody | someone | one | jemand | alguien | quelqu un ) ( should | ought to | needs to | must | will | debe | deberia | devrait ) ( ADV | ADV | finally | please | just ){0,2} ( throw | push | put | run | KILL | HURT | HURTS | shut | teach ) ( .!PLAYED ){0,2} ( YOU | him | her | them | HESHE | GROUP | YOUR )"),
    ("harm", STRONG, "( throw | push | shove | kick | run ) ( YOU | him | her | them ) ( over | down | off | under | out of | in front of | into )"),
    ("harm", FAIR, "( world | place | forum | board | everyone | we ) .{0,5} better ( off )? ( without | if ) ( YOU | HESHE | THEY )"),
    ("harm", STRONG, "geh ( . ){0,1} sterben | stirb | verreck | verrecke | verreckt | krepier | krepiert | hang YOU auf | ersaufen sollen | ( man | wer ) sollte ( YOU | . ){0,3} ( HURTS | EXPEL | aufhangen )"),
    ("harm", STRONG, "( va | allez | vas | peux | peut | tu peux | devrais | doit ) ( YOU )? ( crever | mourir | pendre | noyer | YOU pendre ) | ^ ( DIE ) ( $ | COMMA | salope | connard ) | creve ( COMMA | $ | BADNOUNS ) | ( aurait | auriez | aurais ) ( . ){0,2} YOU noyer | YOU ( pendre | noyer )"),
    ("harm", STRONG, "muerete | pudrete | ahorcate | matate | suicidate | tirate ( . ){0,3} | deberias ( morir | morirte | matarte | estar muerto ) | mereces morir | ojala te"),
    # Threats.
    ("threat", STRONG, "I ( ADV | FUT | BE | be | come | over | AND | there | find | to | then | COMMA | hunt | YOU | down | just | personally | one of these days | know | have | once ){0,8} ( KILL | HURT | HURTS ) "
     "( both | all | up | off | out | in | every one of | each of | open | ADV ){0,3} YOUR ( ADV | . ){0,2} BODY"),
    ("threat", STRONG, "I ( ADV | FUT | BE | be | come | AND | to | then | just ){1,7} ( KILL | HURT ) ( every | each | all ) ( . ){0,2} BODY ( in | of ) YOUR"),
    ("threat", STRONG, "I ( ADV | FUT | BE | be | come | over | AND | there | to | then | just | personally | one of these days | have ){1,7} ( KILL ) ( ADV | both | all ){0,2} ( YOU | YOUR ( mother | wife | kids | family | dog | children | PERSON ) )"),
    ("threat", STRONG, "I ( ADV | FUT | BE | be | come | over | AND | there | to | then | just | personally | have ){1,7} ( HURT ) YOU ( $ | COMMA | up | down | dead | so | until | if | when | AND | like | bloody | senseless | slowly | into | to death | to DET pulp | too | first | ME | one | good | badly | in DET BODY | with DET WEAPON | with my . )"),
    ("threat", STRONG, "I ( ADV | FUT | BE | be | to | then | just | have ){1,6} ( find | get | hunt | track | trace ) YOU ( $ | COMMA | AND | when | if | one | soon | tonight | down | for ( this | that | it | what ) )"),
    ("threat", STRONG, "I ( ADV | FUT | be | BE | to | then | just | have ){1,6} ( come | coming | go | going ) ( over | round | . ){0,1} ( for | after ) ( YOU | YOUR . ) ( $ | COMMA | AND | when | tonight | soon | next )"),
    ("threat", STRONG, "( put | stick | shove | plant | lodge | bury ) DET ( . ){0,1} WEAPON ( . ){0,2} ( in | into | through | round | around | to ) ( YOU | YOUR | HIS | him | her )"),
    ("threat", STRONG, "HURT YOUR ( . ){0,1} ( throat | neck | heart | tongue | spine | windpipe | head off )"),
    ("threat", STRONG, "I ( .!NOT ){0,5} ( burn | torch | bomb | blow up | firebomb | shoot up | set fire to | smash up | trash | raid ) ( . ){0,1} ( YOUR | the | HIS | HIS | MY ) ( . ){0,1} HOME ( down | up | to | $ | COMMA | AND | with )"),
    ("threat", STRONG, "( burn | burning ) YOUR ( . ){0,1} HOME | YOUR ( . ){0,3} will burn ( AND YOU | $ | COMMA | down ) | YOU will ( be | BE ) inside it"),
    ("threat", STRONG, "( make | making ) YOU ( suffer | bleed | beg | scream | regret | pay | disappear | wish YOU ) "),
    ("threat", STRONG, "YOU ( FUT | ADV | BE ){1,3} ( pay for | regret | suffer | bleed | be sorry | burn | die | be dead | end up dead | dead meat | a dead man | fucking dead )"),
    ("threat", STRONG, "( YOU | PERSON ) BE ( ADV | so ){0,2} ( dead ) ( $ | COMMA | meat | if | when | to me | man | next )"),
    ("threat", STRONG, "YOUR days BE ( numbered | over ) | YOU ( wont | FUT not | FUT never | better not | cant ) ( live to | see tomorrow | see the morning | wake up | walk again | make it home | be safe ) | sleep with one eye | say goodbye to YOUR | YOU BE next $"),
    ("threat", STRONG, "I know where ( YOU | YOUR . ) ( live | work | sleep | sleeps | park | drink | go ) ( $ | COMMA | AND | so | now | you ) | I know where YOUR ( kids | children | family | wife | mother ) | wir wissen wo YOU | I weiss wo YOU | se donde ( vives | trabajas ) | I sais ou YOU | YOU sais ou YOU habites | so dove abiti"),
    ("threat", SOME, "I know where YOU ( keep | moor | store )"),
    ("threat", FAIR, "I ( have | got | found ) YOUR ( home )? address | watch YOUR back | next time I ( see | meet | catch | . ) | say that again | come near | continue et I"),
    ("threat", STRONG, "( I | noch ein wort ) ( . ){0,4} HURTS ( YOU | YOUR | DET ){1,3} ( . ){0,1} ( BODY | kaputt | tot | um | fertig | zusammen | ab )"),
    ("threat", STRONG, "I FUT YOU ( ADV | . ){0,2} ( HURTS | DIE | fertigmachen | kaltmachen | kriegen | finden )"),
    ("threat", STRONG, "( I | on ) ( vais | va | YOU | allons | ADV ){1,4} ( HURTS | DIE ) ( $ | COMMA | DET | YOUR | BODY | AND | avec | si )"),
    ("threat", STRONG, "( YOU voy | YOU vamos | voy | YOU ) a ( HURTS | dar una paliza | arrancar | hacer pedazos ) | YOU ( mato | rajo | reviento | parto | rompo ) ( $ | COMMA | DET | BODY ) | voy a ( matarte | partirte | romperte | reventarte | matarlos )"),
    ("threat", STRONG, "I ( mach | mache ) YOU ( . ){0,1} ( fertig | kalt | platt | tot ) | I ( bring | bringe ) YOU ( . ){0,1} um | YOU BE ( tot | ein toter mann ) | t es mort | estas muerto | eres hombre muerto"),
    # Degraded groups.
    ("group", STRONG, "( .!THING!PRON ) ( FOLK | GROUP )? BE ( ADV | DET | born | AND | all ){0,5} SCUM"),
    ("group", STRONG, "( GROUP ( FOLK | . )? | those FOLK | these FOLK | such FOLK | YOUR kind | YOUR sort | YOUR people | YOUR race ) ( here | ADV | who . . )? BE ( ADV | DET | born | AND | like ){0,5} ( <DEGRADED> | BADANIMAL | TRASH | <BAD> )"),
    ("group", STRONG, "( all | every | alle | todos | tous | esos | ces | diese | these | those | les | los | die | the ) ( . ){0,1} ( .!THING!PRON!GENERIC ) ( FOLK )? ( BE ) ( ADV | DET | all | born | AND ){0,4} ( CRIM | PEST | SCUM | BADNOUN | BADNOUNS )"),
    ("group", FAIR, "( .!THING!PRON!GENERIC ) BE ( ADV | DET | all | born | AND ){0,4} ( CRIM | PEST )"),
    ("group", SOME, "( CRIM | PEST | SCUM ) ( AND | COMMA | y | und | et ) ( ADV | DET )? ( CRIM | PEST | SCUM | TRASH )"),
    ("group", SOME, "( PEST | SCUM | CRIM | TRASH ) ( on | of | to ) ( this | MY | the ) ( country | city | town | nation | land | society | world | earth | village )"),
    ("group", SOME, "always ( BE | were | have been ) COMMA? ( AND )? always ( will | be | BE )"),
    ("group", FAIR, "BE ( ADV )? born ( CRIM | PEST | SCUM )"),
    ("group", STRONG, "( .!DET!THING!PRON ) SCUM ( REEK | rob | take | BE | should | must | out | everywhere | . every . )"),
    ("group", STRONG, "( filthy | dirty | stinking | bloody | fucking | fuckin | damn | goddamn | sale | sales | dreckige | dreckiger | scheiss | drecks | sucios | putos | malditos | disgusting ) GROUP"),
    ("group", STRONG, "( GROUP | those FOLK | these FOLK | YOUR kind | YOUR people | alle . | ces . | esos . | diese . | pack ) ( FOLK )? ( all | ADV | nur | just | puent | always ){0,2} REEK ( $ | COMMA | AND | y | et | und | like | every | our | everything | weg )"),
    ("group", STRONG, "REEK AND REEK ( COMMA | $ | weg | dehors | . )"),
    ("group", STRONG, "( should | must | ought to ) ( not | never ) be allowed to ( breed | vote | live | exist | reproduce | have children | have kids | marry | drive | walk )"),
    ("group", STRONG, "( should | must | ought to | need to | needs to ) ( all )? be ( ADV )? ( EXPEL | deported | gassed | shot | exterminated | sterilised | sterilized | wiped out | hanged | lynched | put down | driven out | castrated | rounded up | eradicated )"),
    ("group", FAIR, "( keep | throw | kick | drive | get | driven | thrown | kicked ) ( ( the | these | those | all )? ( .!THING!PRON!GENERIC ) )? out of ( MY | this | the | YOUR ) ( school | schools | country | town | city | street | streets | neighbourhood | neighborhood | community | nation | village | jobs )"),
    ("group", STRONG, "( GROUP | . ) raus $ | auslander raus | fuera ( DET )? GROUP | dehors ( DET )? GROUP | GROUP ( out | go home | get out | not welcome )"),
    ("group", FAIR, "never ( hire | trust | employ | rent to | marry | serve | date ) ( a | an | any | these | those ) ( .!THING!PRON )"),
    ("group", SOME, "( before | since | until ) ( the | these | those ) ( .!THING!PRON ) ( came | arrived | showed up | moved in | turned up | invaded )"),
    ("group", FAIR, "one more ( .!THING!PRON ) family"),
    ("group", STRONG, "( hang | shoot | burn | gas | kill | drown | deport | sink | lynch | exterminate | slaughter | round up | wipe out | send back ) ( <LOT> ) ( $ | COMMA | AND | back | out | now )"),
    ("group", STRONG, "( put | load | pack | stick ) .{1,5} on ( a | DET ) ( boat | ship | train | raft | plane ) AND ( sink | burn | send | push | blow )"),
    ("group", STRONG, "send ( them | these . | those . | all of them | YOU | all DET . ) ( all )? ( back | home ) ( $ | COMMA | AND | where | to ( HIS | YOUR | where | africa | asia ) | on DET ( boat | plane | train | ship ) )"),
    ("group", STRONG, "( go | get | crawl | send | belong | belongs ) ( on )? back ( to | in ) ( the kitchen | YOUR ( own )? country | where ( YOU | THEY ) ( came | come | belong ) | YOUR ( own )? ( shithole | desert | jungle | tribe | hole ) | africa | asia | mexico )"),
    ("group", STRONG, "where YOUR ( kind | sort | lot | people | race ) ( belong | belongs | should ) | YOUR ( kind | sort ) BE NOT ( welcome | wanted | human ) | ( women | woman | girls ) ( belong | belongs | should stay ) in the kitchen"),
    ("group", STRONG, "gehoren ( . ){0,2} ( EXPEL | weg | HURTS | ins gas | an die wand | raus ) | gehort ( . ){0,1} ( EXPEL | vergast ) | il faut ( tous )? ( les | DET ) ( EXPEL | HURTS ) | ( hay | habria | habra | tenemos ) que ( EXPEL | HURTS ) | a la hoguera con ( DET | ellos )"),
    ("slur", STRONG, "SLUR"),
    # Explicit sex.
    ("sex", STRONG, "LEWD"),
    ("sex", FAIR, "PORN"),
    ("sex", STRONG, "( free | watch | hardcore | gratis | gratuit | gratuites | gratuite | kostenlos | download | amateur | live | hd | hot | HOT | teen | gay | lesbian | videos | video | clips ) ( . ){0,1} PORN | PORN ( with | video | videos | movie | movies | film | clips | site | sites | star | stars | gratis | gratuit | gratuites | kostenlos | free | hd | COMMA )"),
    ("sex", STRONG, "NUDE ( .!STUDY ){0,2} ( PARTNER | PHOTO | bodies | body ) | ( PARTNER | PHOTO ) ( BE | DET | of ME | of YOU | COMMA )? NUDE | ( full | fully | uncut | totally | all ) NUDE ( COMMA | $ | write | . PHOTO | PHOTO | video | on )"),
    ("sex", STRONG, "( strip | picture | picturing | imagine | imagining | want | see | dream of | dreaming of | undress | need ) ( ADV )? ( to see )? ( YOU | her | him ) ( . ){0,1} NUDE | NUDE ( on top of | in MY bed | auf DET | in DET bed | under MY ) | strip ( YOU | her | him ) "),
    ("sex", STRONG, "( want to | going to | gonna | FUT | I | let ME | to | AND | he | she | they | envie de ) ( ADV | DET | YOU ){0,3} FUCK ( YOU | her | him | ME | them | YOUR | all night | hard | harder | toute | on | $ | in | PARTNER )"),
    ("sex", STRONG, "FUCK ( her | him | them ) | FUCK ( ME | YOU ) ( hard | harder | all | on | in | now | tonight | deep | senseless | toute | toda | from | again and ) | NIGHT ( . ){0,1} FUCK | ( follarte | cogerte ) | YOU FUCK ( $ | toute | toda | NIGHT )"),
    ("sex", STRONG, "spread ( her | his | YOUR | MY | those | HIS ) ( legs | BODY | cheeks | thighs ) | ( took | take | fuck | fucked | taken ) ( her | him | ME | YOU ) from behind | ( thrust | thrusting | thrusts | entered | slid | slides | pushed ) ( . ){0,3} ( inside | into | deep ) ( . ){0,1} ( her | him | ME | PARTS )"),
    ("sex", STRONG, "( suck | lick | stroke | ride | rub | eat | sucks | licks | sucking | licking | taste | touch | jerk ) ( . ){0,2} ( PARTS | YOUR cum )"),
    ("sex", STRONG, "( MY | YOUR | her | his | HIS | hard | wet | big | huge | tight ) ( . ){0,1} PARTS"),
    ("sex", STRONG, "( pic | pics | photo | photos | fotos ) of YOUR ( . ){0,1} ( PARTS | ass | NUDE | body ) | send ( ME )? ( . ){0,2} ( nudes | NUDE . )"),
    ("sex", STRONG, "( moan | moaning | moans | moaned | orgasm | climax | came | cum ) ( . ){0,2} ( all night | on top | MY name | hard | inside | in her | on her | on his | loudly )"),
    ("sex", FAIR, "moaning | moaned | orgasm | orgasms | masturbate | masturbating | masturbation | striptease | kamasutra"),
    ("sex", STRONG, "SEX ( NIGHT | chat | cam | cams | video | videos | tape | slave | toy | with ( YOU | her | him | ME | PARTNER | a stranger | strangers ) | in the . ) | ( want | have | having | wants | quieren | quiero | looking for | need | had | free | casual | anal | oral | wild | hot | gratis ) ( . ){0,1} SEX ( NIGHT | with | $ | COMMA | chat | now | in )"),
    ("sex", FAIR, "HOT ( COMMA | AND )? ( HOT | . )? PARTNER"),
    ("sex", STRONG, "( geile | geiler | geil | heisse | scharfe ) ( . ){0,1} ( PARTNER | NUDE | PARTS | weiber ) | wet AND willing | HOT AND ( willing | ready | wet | horny )"),
    ("sex", SOME, "PARTNER ( in | near ) ( YOUR area | YOU ) | private ( pics | photos | message | show ) | no signup | click ( here | for ) | klick hier | chaudes ce soir | PHOTO set | topless | photo set"),
    ("sex", FAIR, "NUDE ( COMMA | $ )"),
    ("sex", FAIR, "( pushed | pressed | bent | threw | pinned ) ( her | him | ME ) ( against | over | down | on ) ( . ){0,5} NUDE"),
    ("sex", FAIR, "begged ( him | her | ME ) ( to | for ) "),
]


def inflected(word: str, kind: str) -> list[str]:
    """A word with its regular endings; some of the forms don't occur."""
    if kind == "endings":
        return [word, *(word + x for x in ("e", "er", "en", "es", "em", "s"))]
    if kind == "adjective":
        stem = word[:-1] + "i" if word.endswith("y") else word.removesuffix("e")
        return [word, stem + "er", stem + "est"]
    if kind == "noun":
        if word.endswith("s"):
            return [word, word + "es"] if word.endswith("ss") else [word]
        if word.endswith(("x", "ch", "sh")):
            return [word, word + "es"]
        if word.endswith("y") and word[-2] not in "aeiou":
            return [word, word[:-1] + "ies"]
        return [word, word + "s"]
    stem = word[:-1] if word.endswith("e") else word
    double = stem + stem[-1] if len(stem) < 6 and stem[-1] not in "aeiouywxk" and stem[-2] in "aeiou" and stem[-3:-2] not in tuple("aeiou") else stem
    third = word + "es" if word.endswith(("s", "x", "ch", "sh")) else word + "s"
    return [word, third, double + "ing", double + "ed"]
