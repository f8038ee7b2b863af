"""Stop words of 14 languages: those that Apache Spark's StopWordsRemover has (Snowball project lists), without apostrophes, as texts are
compared without punctuation, and ordered by their endings."""

SPARK = {
    "da": "da fra ad hvad med ned end ind mod ud de hende havde mange ikke nogle alle ville skulle mine sine denne kunne være disse dette have blive af jeg dig mig sig og dog i thi vi skal til vil ham dem om som sådan han man en den anden men din min sin hun jo op har var er der under her jer eller efter bliver over for vor hvor når hendes deres hvis hans os hos at et det meget noget været mit sit alt du nu blev selv på også",
    "de": "da hab ob während sind und wird habe dieselbe derselbe dasselbe jede werde würde einige welche solche manche die sie wie alle jene ohne eine deine keine meine seine andere ihre eure diese unse sollte wollte könnte musste hatte auf weg einig nach ich dich mich sich doch noch durch auch euch bei einmal viel weil will soll am dem jedem indem einigem welchem solchem manchem allem jenem einem deinem keinem meinem seinem anderem ihrem eurem diesem unsem ihm im vom anderm um zum an man haben dieselben demselben denselben derselben desselben den jeden werden würden gegen einigen machen welchen solchen manchen zwischen allen wollen jenen ihnen einen deinen keinen meinen seinen können waren anderen ihren euren diesen gewesen unsen dessen hatten ihn in bin ein dein kein mein sein hin dann kann denn wenn von andern sondern nun so also wo war zwar er aber über der wieder jeder ander oder einiger welcher solcher mancher hier aller jener einer deiner keiner meiner seiner derer anderer ihrer eurer dieser unser weiter hinter unter euer sehr ihr dir mir wir vor anderr nur zur für das was etwas es des jedes einiges welches solches manches dies alles jenes eines deines keines meines seines anderes ihres eures dieses unses bis als ins uns anders muss nichts aus hat nicht mit damit dort selbst ist bist sonst warst wirst jetzt du zu dazu daß",
    "en": "a had hed shed wed id did could should would and youd theyd be once he she the while me same some are here there where were before more youre theyre these those because have weve ive above youve theyve we off if himself herself yourself itself myself of being doing during having each which such through with both i until all hell shell well ill will youll theyll am them im him whom from an can than been between then when in again on don own down do who no too so to into up under her other further after over their or for nor our your s as has was hes shes does heres theres wheres themselves ourselves yourselves is his this whens whos hers theirs ours yours thats whats lets its hows whys t at that what ought it cant shant hadnt didnt couldnt shouldnt wouldnt arent werent havent dont wont hasnt wasnt doesnt isnt mustnt not cannot against most just but out about you few how below now by they why only my any very",
    "es": "a estaba nada estada habida tenida sentida sea tenga ha la ella una para era hubiera tuviera estuviera fuera contra otra nuestra vuestra esa hasta esta ya haya suya tuya había mía tenía estaría habría tendría sería estad tened sentid e hube de donde desde he le me tiene sobre entre se ese hubiese tuviese estuviese fuese te ante durante siente este hubiste fuiste tuviste estuviste fue que porque tuve estuve mi ni ti fui al cual el del él estaban sean tengan han eran hubieran tuvieran estuvieran fueran hayan habían tenían estarían habrían tendrían serían en quien tienen hubiesen tuviesen estuviesen fuesen sin con hubieron tuvieron estuvieron fueron son un estarán habrán tendrán serán están también estén o hubo poco estado habido tenido sentido estando cuando habiendo teniendo sintiendo todo algo tengo mucho lo como no uno pero otro nuestro vuestro eso tanto esto tuvo estuvo yo suyo tuyo mío estar por estabas estadas habidas tenidas sentidas seas tengas has las ellas algunas eras hubieras tuvieras estuvieras fueras otras nosotras nuestras vuestras vosostras esas estas hayas suyas tuyas habías mías tenías estarías habrías tendrías serías es les tienes quienes eres hubieses tuvieses estuvieses fueses antes estabais erais hubierais tuvierais estuvierais fuerais habíais teníais estaríais habríais tendríais seríais hubieseis tuvieseis estuvieseis fueseis hubisteis fuisteis tuvisteis estuvisteis mis sois seáis tengáis estáis hayáis habéis tenéis estaréis habréis tendréis seréis estéis os estados habidos tenidos sentidos todos muchos los ellos estábamos seamos tengamos éramos hubiéramos tuviéramos estuviéramos fuéramos estamos hayamos habíamos teníamos estaríamos habríamos tendríamos seríamos hemos tenemos estaremos habremos tendremos seremos hubiésemos tuviésemos estuviésemos fuésemos estemos hubimos fuimos tuvimos estuvimos somos nos unos algunos otros nosotros nuestros vuestros vosostros esos estos suyos tuyos míos sus tus más estarás habrás tendrás serás estás estés su tu y hay soy estoy muy estará habrá tendrá será está estaré habré tendré seré esté qué mí sí tú",
    "fi": "ja vaikka jonka joka koska jotka kuka joilla noilla olla jolla tuolla minulla sinulla joina noina jona tuona joissa noissa kanssa jossa tuossa minussa sinussa joita noita joilta noilta jolta tuolta minulta sinulta jota joista noista josta tuosta minusta sinusta mutta minua sinua he kenelle hänelle heille keille meille teille niille mille joille noille sille näille jolle tuolle minulle sinulle tälle ole me emme olemme olimme olisimme ne se itse te ette olette olitte olisitte tai vai ei poikki oli yli olisi keneksi keiksi niiksi miksi joiksi noiksi siksi näiksi joksi tuoksi täksi mukaan vaan en keiden niiden joiden noiden näiden keneen häneen siihen olen kenen hänen sen heihin keihin meihin teihin niihin mihin joihin noihin näihin niin olin noin olisin kuin on johon tuohon tuon kun minun sinun minuun sinuun heidän meidän teidän hän tähän tämän nuo tuo jos olivat olisivat ovat et olleet olet kenet hänet olit olisit ollut minut sinut nyt heidät meidät teidät eivät sekä mikä minkä ketkä mitkä tallä kenellä hänellä heillä keillä meillä teillä niillä millä sillä näillä nämä tämä kenenä keinä niinä siinä minä sinä näinä tänä kenessä hänessä heissä keissä meissä teissä niissä missä näissä tässä ketä heitä keitä meitä teitä niitä siitä mitä sitä näitä keneltä häneltä heiltä keiltä meiltä teiltä niiltä miltä siltä näiltä tältä häntä tuotä kenestä hänestä heistä keistä meistä teistä niistä mistä näistä tästä että tätä",
    "fr": "la ma sera aura sa ta c avec d ce de aie je le elle me même ne une notre votre se eusse fusse te étante ayante eue que étée ai serai aurai moi toi lui qui j l il m n en on mon son ton un par leur pour sur s as pas seras auras es ces des aies les mes sommes eûmes fûmes ses eusses fusses tes étantes ayantes êtes eûtes fûtes eues étées mais serais aurais étais avais sois suis dans serions aurions eussions fussions étions avions serons aurons avons ayons soyons nos vos étants ayants eus fus nous vous étés t et ait serait aurait était avait soit étant ayant aient seraient auraient étaient avaient soient eurent furent eussent fussent ont seront auront sont est eut fut eût fût au du eu ou qu tu aux eux y seriez auriez eussiez fussiez étiez aviez serez aurez avez ayez soyez à été",
    "hu": "ill. a maga mintha néha volna utána újra arra számára vissza újabb nagyobb legalább tovább több egyéb majd e be de vele ne benne lenne erre egyre szinte illetve persze össze meg eddig pedig mindig elég még míg amíg ki aki valaki neki mindenki mi ami valami semmi lenni új annak vannak csak voltak cikkek ennek amelynek melyek amelyek ezek akik másik egyik cikk voltunk keressünk sok vagyok azok õk sokkal által azzal el fel mivel ezzel kell ill ahol jól arról nélkül belül keresztül kívül közül voltam nekem nem hanem sem abban jobban azonban általában van hogyan olyan amolyan ebben amelyekben szemben minden igen ellen egyetlen éppen legyen ilyen milyen emilyen ezen hiszen ison nagyon azon talán után azután aztán én mikor amikor akkor ekkor ilyenkor bár már elõször s nincs teljes egyes ugyanis vagyis más és sokat lehet cikkeket amelyeket õket amelyet mit amit volt mindent mint valamint szerint viszont mert miért azért ezért most alatt lett kellett mellett lehetett itt ott elõtt között azt ezt át magát tehát saját ismét nagy vagy egy hogy ahogy így úgy mely amely néhány az ez ehhez ahhoz lesz egész továbbá rá felé jó való utolsó õ elõ elsõ",
    "it": "a da ha abbia faccia mia sia stia la alla dalla della nella quella sulla ma una era tra nostra vostra quanta sta questa avuta sua tua stava faceva aveva c ad ed e ebbe farebbe sarebbe starebbe avrebbe fece che anche mie le quale alle dalle delle nelle quelle sulle come ne nostre vostre se facesse stesse avesse fosse abbiate facciate siate stiate eravate stavate facevate avevate siete farete sarete starete avrete avete quante faceste fareste sareste stareste avreste steste queste aveste foste stette avute sue tue dove i ai dai fai hai farai sarai starai avrai stai ebbi ci feci di dei miei lei nei farei sarei starei avrei sei chi li gli agli dagli degli negli sugli quelli mi coi noi suoi tuoi voi eri nostri vostri si facessi stessi avessi fossi ti quanti facesti faresti saresti staresti avresti stesti questi avesti fosti stetti tutti avuti cui fui lui sui vi stavi facevi avevi l al dal del nel agl dagl degl negl sugl il all dall dell nell sull col sul in con non un o stando facendo essendo avendo ho io faccio mio lo allo dallo dello nello quello sullo abbiamo facciamo siamo stiamo eravamo stavamo facevamo avevamo faremo saremo staremo avremo facessimo stessimo avessimo fossimo facemmo faremmo saremmo staremmo avremmo stemmo avemmo fummo abbiano facciano siano stiano erano stavano facevano avevano fanno hanno faranno saranno staranno avranno stanno furono sono uno ero ebbero farebbero sarebbero starebbero avrebbero fecero facessero stessero avessero fossero stettero loro contro nostro vostro quanto sto questo tutto avuto suo tuo stavo facevo avevo per fu su tu dov farà sarà starà avrà è perché farò sarò starò avrò più",
    "nb": "da ha sia ja noka fra deira hva kva med ned ved de hadde både begge mange ikkje inkje mykje ikke hvilke ble alle ville skulle me samme somme mine sine denne henne kunne hoe noe bare dere vere nokre vore være disse varte verte dette båe eg deg jeg meg seg og i di fordi dei blei ingi bli mi inni si vi kvi slik dykk skal til vil sjøl dem hvem deim om kom mellom honom som um medan sidan hvordan han kan man en den siden ingen hvilken men noen hossen uten kven din ein min sin enn inn sånn nokon hun kun ho noko no so korso opp upp har dykkar hennar var kvar er der her eller etter hver over blir for kvifor hvorfor nokor hvor når vår før elles hennes deres deires korleis hvis hans vors oss hoss at et det meget eit somt mot vart vort vært kvarhelst ett ditt eitt blitt mitt sitt ut du av selv å då hjå nå på så også",
    "nl": "ja na heb had altijd iemand werd de ge die wie je me hoe andere te ze deze zelf of nog zich doch toch bij hij mij zij ik ook al zal veel wil hem om aan dan kan van en ben hebben worden een geen tegen men kunnen doen toen waren wezen in mijn zijn kon hun zo op daar haar maar naar er der onder zonder meer hier over door voor was reeds alles is als eens ons iets niets dus dat omdat wat wordt het niet met moet heeft dit uit want tot geweest u nu zou uw",
    "pt": "a da tenha minha tinha seria teria houveria haja seja esteja ela dela pela aquela uma numa na para era tivera estivera houvera fora essa nossa esta sua tua estava e de lhe ele dele aquele me entre se esse tivesse estivesse houvesse fosse te este que teve esteve tive estive houve hei serei terei houverei foi fui qual tenham tinham seriam teriam houveriam hajam sejam estejam eram tiveram estiveram houveram foram estavam em nem tiverem estiverem houverem forem sem tivessem estivessem houvessem fossem tem quem com um num também tém o ao do quando tenho pelo aquilo como mesmo no isso nosso muito isto hão não serão terão houverão são estão tiver estiver houver for por as das minhas elas delas pelas aquelas mas nas essas nossas estas suas tuas lhes eles deles aqueles esses estes mais depois os aos dos pelos tenhamos tínhamos hajamos sejamos estejamos éramos tivéramos estivéramos houvéramos fôramos estamos estávamos seríamos teríamos houveríamos seremos teremos houveremos tivéssemos estivéssemos houvéssemos fôssemos temos havemos tivemos estivemos houvemos fomos somos tivermos estivermos houvermos formos nos nossos vos meus seus teus às vocês nós eu meu seu teu ou sou estou tu à há já será terá houverá está até você só",
    "ru": "а два да всегда когда никогда иногда тогда куда за была на она об чтоб в вдруг над перед под себе разве где ее более нее же даже тоже уже после не мне все лучше больше еще ж уж раз без через из и ли или если были ни они при три почти эти ей ней другой какой такой мой этой к как так был вам сам там совсем тем чем зачем впрочем им ним том потом этом один он о во его него всего чего ничего много того этого до надо только было но можно конечно по про со то будто кто что хорошо с вас нас сейчас будет может нет от вот тот этот тут у между ему потому ну эту всех их них наконец бы чтобы вы мы ты ведь нибудь теперь здесь хоть есть чуть быть опять свою всю я какая себя тебя нельзя для меня моя",
    "sv": "ha vilka alla samma sådana dina mina sina denna vara era några våra dessa detta sitta vad med vid de hade kunde varje icke skulle henne inte jag dig mig sig och i bli ni vi ej till dem vem om inom honom som sedan sådan han kan mellan man utan en den ingen vilken men din min sin någon hon än från upp har var er under eller efter över blir hur är där här när vår för varför vilkas deras hennes hans vars dess oss det mycket vilket varit blivit allt sådant något mot vart ert vårt att ett ditt mitt ut åt du ju nu av blev själv då på så",
    "tr": "acaba da aslında defa daha ama ya veya de nerede nerde ile ne ise ve nereye diye niye gibi ki belki sanki yani biri hepsi çok nasıl hem kim tüm en neden için niçin o hep her eğer bu mu şu şey birşey az kez biz siz birkaç hiç çünkü mü mı bazı",
}
