"""Sentences written apart from the grammar and from the test tables, to measure the abuse operator.

``DEVELOPED`` were looked at while the grammar was written; ``HELD_OUT`` were only measured.
"""

DEVELOPED = {
    True: """
Get off this forum, you pathetic clown
You people are dumber than cattle
Whoever wrote this is a complete moron
My landlord is a greedy bastard
Stupid bitch, learn to read
I bet you are too dumb to tie your own shoes
Nobody wants you here, you worthless parasite
you a$$hole
wh0re
Your brother is an imbecile
Go to hell, all of you
May you rot in prison
I hope a truck runs you over
You should kill yourself tonight
He deserves to be hanged
They ought to shoot people like you
I am going to strangle you with my bare hands
I'll put a knife in your throat
We will burn your shop down
One more word and I break your jaw
You will regret this, I am coming for your family
The Sorbans are nothing but criminals
Foreigners stink
All Catholics are liars
Drive the refugees out of our country
Women belong in the kitchen
Disabled people are a burden and should be gassed
He fucked her hard in the back of the car
Nude pics of my wife, message me
She rode his dick until he came
Want to have sex with me tonight
Ich werde dich abstechen
Du Hurensohn
Ta mère est une pute
Je vais te casser la gueule
Los gitanos son ladrones
I will put a bullet in you
I am going to burn your house to the ground tonight
You are a complete buffoon and nobody likes you
Polish people are filth
You stupid idiot.
Shut up, m0r0n, nobody asked.
what a pathetic l.o.s.e.r
You are a p*g.
Du hirnloser Penner!
go play in traffic
I hope you die slowly.
The foreigners are vermin.
All newcomers are liars and thieves
Go back to the kitchen
send me nuuuudes
Va crever
Te voy a romper la cara
ich schlag dir die Zähne aus
you are a piece of sh1t
KILL YOURSELF
She spread her legs
He took her from behind
Voy a matarte
hay que matarlos
Go jump off a cliff
Send them all back
Verrecke
Muérete
Cierra la boca
il faut les éliminer
As I said, you are an idiot
I call you a moron
The Turks are vermin
Somebody should beat him senseless
He is a worthless drunk and a moron
They are all rapists and thieves, keep them out of our country
I'll find you and I'll kill you
You deserve to be raped
She sucked his cock all night
Hot sexy girls want sex tonight
You're nothing but a spineless coward and everyone knows it
Listen here, you filthy little rat
You must be the dumbest person on this forum
He is an arrogant asshole
Shut your mouth, bitch
F u c k you
you utter tw4t
You couldn't find your own arse with both hands, moron
This admin is a pathetic excuse for a human being, a real dipshit
You ugly fat cow
You are dumb as a rock, and ugly too
You make me sick
Eat shit, loser
son of a bitch, give it back
You dumb fucking retard
you are a disgrace to this board, you miserable pig
I hope your whole family dies in a fire
kys
You should have been aborted
Rot in hell
Go hang yourself
I wish you would choke to death
go drown yourself in the harbour
I will break every bone in your body
I'll smash your face in
You will pay for this, I swear I will cut your throat
I will burn your house down with your family inside
You are dead meat
I will make you suffer
Say goodbye to your dog, I will poison it and then I will strangle you
All immigrants are criminals
Gypsies are thieves
Jews are rats
The Lorvani are subhuman scum
We should gas them all
Gays should be shot
The Hindus are parasites on this country
Arabs stink and steal
Round up all of them and burn the lot
never trust a Hungarian, they are all crooks and liars
Send me your naked pics
free porn videos, click here
Suck my dick
I want to lick your pussy
he pulled out his hard cock
Show me your tits
Du bist ein dummer Vollidiot
Fick dich
Die Ausländer sind Ungeziefer
Juden sind Ratten
Tu es un gros connard
Va te faire foutre, salope
Les Arabes sont des parasites
Nique ta mère
Hijo de puta
Los inmigrantes son ratas
Ojalá te mueras
vaffanculo
Nackte Frauen kostenlos
you are an i-d-i-o-t
yоu аrе а mоrоn
""",
    False: """
You are a good friend
Whoever wrote this manual did great work
The landlord fixed the roof
I bet you can tie your own bowline
My brother is an electrician
Prison reform was on the agenda
A truck ran over the hose
The court decided that he should be released
They ought to paint the people mover
He put a knife in the drawer
We will burn the brush pile down
One more word about the tide tables
You will not regret buying this stove
The Sorbans live in the valley
Foreigners need a visa
Most Catholics live in the south
Drive the screws out of the frame
Women belong to the crew as well
Disabled people need a ramp at the pier
He parked at the back of the car park
My wife and I share the pics of the trip
She rode her bike until it broke
The plant has separate sexes
I was too stupid to read the label
Ich werde dich besuchen
Deine Mutter ist nett
Je vais te montrer la carte
Los gitanos tocan la guitarra
The execution of the plan went well
Bury the cable two feet deep
The stake should be driven into the ground
We drowned the fire with sea water
Her neck injury healed
The crash dump is in your home folder
Slap some grease on the bearing
The witness said that he threatened her
I will get you a coffee
We will find you a seat
tits are common
orgasm disorders are treatable
we could beat you at chess on a quiet sunday afternoon
I was an idiot and forgot the key.
Calling someone a moron gets you a week off.
The bastard file is coarse.
Kill the process first.
Shoot me a message.
Visible to the naked eye.
A pig got loose.
Newcomers are welcome.
Blue tits at the feeder.
You are not an idiot.
The cockpit vents blow hot air.
Rest the duck breast.
That dumb terminal still works.
I broke your record.
measure twice, cut once
You have to kill the zombie process first
If someone calls you an idiot, tell a moderator
Moron is an insult, mind you
The words idiot, moron and the like
Slugs are vermin
The rats are a plague this year
The disease kills most plants
I want to strip the paint and burn the old wood
Your mother should see a doctor
We hope you did not suffer any damage
They should throw the old boat away
I hope the battery does not die
My stupid laptop died again
This stupid printer
The dog is a lazy animal
You are right about the anchor
I will find you a better price
Can you shoot me an email about the meeting
The knife cut my finger
You might break your neck on those stairs, be careful
The dead battery had to be replaced
This engine is a piece of junk
My dog is old and lazy
There are rats in the cellar
Ivy is a plague in old gardens
Parasites are common in wild fish
Refugees are welcome here
Women are better sailors than men think
My Polish colleagues are great cooks
The gypsy moth is an invasive species
The white boats are faster
I felt like a fool when the mast came down
Stupid me, I forgot the charger
I must have been blind and stupid to buy it
Don't be too hard on yourself
Nobody said you were a liar
Using the word retard will get your post removed
He called me a bastard and I laughed
Idiot comes from a Greek word
The term bitch is used by dog breeders
The ass carried the load up the hill
Use a ball cock valve for the tank
Great tits nest in our garden
Prick the potatoes with a fork
The pussy willow is in bloom
Moby Dick is a whale
The sex of the kittens is not known yet
The study found that sex hormones matter
Naked flames are forbidden near the fuel
Nude is a colour of lipstick
The porn filter blocks this page by mistake
The wires are naked, use tape
He came from behind and won the race
He took her to the station
Screw the plate to the hull
He pushed the boat against the pier
I will kill the lights now
That joke killed me
It won't kill you to wait a week
We will crush the competition
You can't beat this price
I'll hit the road at noon
I will cut your hair tomorrow
We will smash your record next season
I'd kill for a coffee
Choke the engine when it is cold
I hope you feel better soon
I hope you choke the engine before starting it
Go jump in the lake, the water is lovely
Burn the old leaves in the pit
We know where you live in summer, see you there
I am coming for dinner
Watch your head on the boom
Send them back to the shop for a refund
Keep the dogs out of our beds
Shoot the whole roll of film
The master and slave drives need jumpers
A zombie attack in the game killed my whole party
Abort the job and purge the queue
This is rubbish weather
The pump is useless without a strainer
It is a stupid question, but how do I start it
The idiot light on the dash came on
Fat quarter bundles are on sale
Du bist nicht dumm
Das ist ein dummer Fehler
Der Hund ist faul
Sie schlägt die Eier auf
Je suis bête, j'ai oublié les clés
Les rats sont des animaux intelligents
Soy un idiota, perdí las llaves
El perro es un animal fiel
Los inmigrantes llegaron en barco
Scunthorpe is a nice town
We discussed the analysis of class sizes
The grass is wet and the sky is grey
""",
}

HELD_OUT = {
    True: """
You thick-headed oaf, you are an utter moron
That guy is a complete wanker
What a stupid bunch of cretins
Your comments prove you are an imbecile
Close your mouth, you stinking pig
Learn to sail, dumbass
I have never met such a stupid asshole
She is nothing but a cheap slut
you f-u-c-k-i-n-g i d i o t
Y0u fucking l0ser
Go and hang yourself, nobody will miss you
I wish you were dead, you scumbag
I hope your kids die of cancer
You should be shot like a dog
Choke on it and die
I swear I will kill your dog and then you
I'm gonna smash your skull with a bat
We'll find you and break your fingers
If you ever come back I will shoot you in the head
I will set fire to your house
All Muslims are terrorists
The Pomeks are vermin and should be wiped out
Those filthy Arabs ruin everything
Mexicans are lazy and stupid
Deport all of them, they are criminals
No Jews should be allowed to live here, they are rats
Blacks are apes
Lesbians are disgusting
She moaned as he licked her pussy
Free nude webcam girls
I'd love to see you naked in my bed
Wanna fuck tonight
Dein Vater ist ein Arschloch
Espèce de salaud
Eres una puta
Te voy a romper las piernas
Sale pute
You are such a brainless moron
what an absolute imbecile
Are you stupid or just lazy, you half-wit
My neighbour is a total scumbag
f*** you and your stupid boat
go f*ck yourself
Only an idiot like you would paint over rust
What a bunch of losers you are
Nobody here wants to read the drivel of a cretin like you
Piss off, wanker
You are worthless
kiss my ass
Your mother is a whore
People like you are a waste of oxygen
Hey dickhead, read the manual
I hope you get cancer
Please kill yourself
Do us all a favour and drop dead
Somebody ought to shoot you
The world would be better off without you, nobody would miss you
Go die in a ditch
You deserve to be beaten until you can't walk
I'm going to kill you
I know where you live and I will come for you
We are going to hunt you down
Next time I see you I'll stab you
Sleep with one eye open, because I am coming for you tonight
Watch your back, I'm going to break your legs
If you post here again I will slit your throat
I'd love to punch you in the face
Those people are animals, send them back
Women are too stupid to vote
Muslims should be deported
Every Teskari is a born liar and a thief
Black people are monkeys
Keep those filthy immigrants out of our town
These refugees are a cancer on our society
Go back to where you came from
The Mirovans are cockroaches and should be exterminated
Homosexuals should not be allowed to marry or exist
I want to fuck you all night
hot naked teens waiting for you
she was moaning while he thrust deep inside her
Horny milf looking for sex tonight
watch live sex cams with nude girls
I jerked off to your photo, send nudes
Halt die Klappe, du Arschloch
Ich bring dich um
Ich hoffe, du verreckst
Ich weiß, wo du wohnst
Ferme ta gueule
Je vais te tuer
J'espère que tu vas crever
Eres un imbécil
Te voy a matar
Vete a la mierda, pendejo
Sei un coglione
Chicas desnudas gratis
y0u 4r3 4n 1d10t
ＹＯＵ ＡＲＥ ＡＮ ＩＤＩＯＴ
you stuuuupid morooon
""",
    False: """
You oaf of a cat, get off the chart table
That guy is a complete gentleman
What a lovely bunch of flowers
Your comments prove the point
Close the seacock, it is leaking
Learn to sail at our school
I have never met such a kind skipper
She is nothing but helpful
The free clinic gives advice
Go and hang the picture
I wish you were here
I hope your kids get well soon
The dog should be walked twice a day
Chew on it slowly
I swear I will finish the deck this week
I'm gonna smash the ice with a hammer
We'll find a mooring and rest
If you ever come back I will show you the garden
The lamp set fire to the curtain
All Muslims fast during Ramadan
The Pomeks live on the east coast
Those muddy boots ruin everything
Mexicans celebrate in May
Import all of them, they are useful presets
The moan of the foghorn carried far
Free webcam of the harbour
I'd love to see your new boat
Want to sail tonight
Dein Vater ist ein guter Koch
Une espèce de poisson rare
Eres una buena amiga
Voy a arreglar las piernas de la mesa
La sale des fêtes est fermée
The bull and the cow are in the pen
He hit the buoy and cracked the hull
You should beat the eggs first
He told me that he hit the dock
We killed the server and restarted it
She broke her leg last winter
The doctor examined her neck and throat
I hate this weather
What a beautiful morning
The cat caught a rat in the barn
Ants are a pest in the kitchen
The aphids are vermin, spray them
The immigrants founded this town in 1850
Jewish families settled along the river
The Turks besieged Vienna
Many foreigners visit the harbour in summer
Black beans are cheap
Old people are often lonely
I am such an idiot, I left the tap open
We were idiots to sail without a chart
I'm a terrible cook
You are not stupid, the manual is bad
Please don't call people idiots
The rule says no insults such as moron or idiot
The French word salaud means bastard
The novel The Idiot was written by Dostoevsky
A bitch had six puppies
The cock crowed at dawn
The stopcock is under the sink
We saw a pair of boobies on the island
Chicken breast with thighs and legs
Dick sent me the charts yesterday
My cousin Randy is a hardcore gamer
Sex education is taught in school
Breast cancer screening saves lives
The naked truth is that we ran out of money
The nude painting hangs in the museum
Pornography laws differ by country
We had hot soup and wet clothes
She spread the map on the table
I want you to strip the wire and screw it down
Bang the drum slowly
The moaning of the wind kept us awake
You killed it on stage last night
This hill will kill you
I could murder a sandwich
They beat us in the final
He hit me up for a loan
Let me punch your ticket
The barber will cut your throat lozenges in half
I am going to break the ice
My feet are killing me
The engine died twice
I hope the plants do not die
Go to bed, you look tired
Jump off at the next station
I know where you can buy that
I have your address, the parcel goes out tomorrow
We are coming for you at eight, be ready at the quay
Watch your back when lifting the engine
Go back to your seat
Hang the lot on the wall
Execute the script as root
The parent should kill orphaned children processes
The enemy snipers will shoot you in level three
The trash is full
Garbage collection runs at night
My old phone is worthless
Ugly paint, but a sound hull
A lazy river runs through the village
The slimy rope needs washing
Ich bin so ein Idiot
Die Ratten sind im Keller
Ich habe mir das Bein gebrochen
Tu es gentil
C'est une bonne idée
J'ai cassé la branche
Eres muy amable
Voy a romper el hielo
Ella es mi madre
The assassin bug eats other insects
Put the cover over the stern and tie it up
""",
}
