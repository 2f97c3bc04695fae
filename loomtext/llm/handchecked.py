"""Chunks labelled by hand, to calibrate the junk classifier and to measure it: 1 junk, 0 prose."""

CHUNKS: list[tuple[str, int]] = [
    ("The baker opened the shop at six and sold every loaf before noon. Nobody complained.", 0),
    ("Why did the old clock stop again?", 0),
    ("It rained all day, and the river rose until the footbridge was under water.", 0),
    ("1. First wash the rice until the water is clear.\n2. Then cook it slowly with a pinch of salt.\n3. Let it rest before you serve it.", 0),
    ("Over the hill the evening fell,\nand in the reeds a single bell\nwas ringing for the boats at sea,\nand no one heard it but for me", 0),
    ("\"We will be there by nine,\" she said, \"unless the train is late.\" He did not answer.", 0),
    ("Le marché ouvre tôt le matin, mais les pêcheurs arrivent avant tout le monde.", 0),
    ("Pourquoi la porte reste-t-elle ouverte quand il fait si froid?\nPersonne ne le sait, et personne ne la ferme.", 0),
    ("Der Zug kam zu spät, weil auf der Strecke ein Baum lag. Die Leute warteten im Regen.", 0),
    ("Wenn der Ofen kalt ist, dann dauert es länger, bis das Brot fertig wird.", 0),
    ("La casa estaba vacía desde el invierno, y en el patio crecía la hierba.", 0),
    ("¿Por qué no vino nadie a la reunión? Porque la carta se perdió en el correo.", 0),
    ("Es gibt drei GrÃ¼nde, warum die BrÃ¼cke geschlossen bleibt, und keiner davon ist neu.", 0),
    ("She kept the le�ter in a drawer for ten years and never read it a�ain.", 0),
    ("The committee met twice. It agreed on the first point &amp; left the second one open for the spring.", 0),
    ("Notes on the garden\nThe roses are late this year because the frost came back in April. We cut them down to the third bud.", 0),
    ("For this you need:\n- flour\n- water\nMix the flour with the water and leave the dough under a cloth for an hour. After that it should have grown to twice its size, and you can shape it by hand.", 0),
    ("I tried `make install` first. It ended with an error that I could not explain, so I looked at the log and found that the disk was full.", 0),
    ("> Does this work with the older version?\nNo, it was added in the last release, but you can build it from the source.", 0),
    ("THE HARBOUR WAS CLOSED FOR THE WINTER AND ALL OF THE BOATS WERE ON THE SHORE.", 0),
    ("Question: What is the boiling point of water on a mountain?\nAnswer: It is lower than at the sea, because the air has less pressure there.", 0),
    ("Step 1. Open the lid and take out the filter.\nStep 2. Rinse the filter under the tap until it is clean.", 0),
    ("Write to us at post@office.example if the parcel has not come within two weeks, and we will send you another one.", 0),
    ("A short one is still a sentence.", 0),
    ("Il faut que la farine soit sèche.\n- sel\n- eau\nOn mélange le tout avec les mains, puis on laisse la pâte sous un linge pendant une heure.", 0),
    ("apple\npear\nplum\ncherry\nquince\nmedlar", 1),
    ("- hammer\n- saw\n- plane\n- chisel\n- rasp\n- clamp\n- square", 1),
    ("Home | About | Products | Contact | Login | Cart", 1),
    ("Start » Shop » Tools » Saws\nStart » Shop » Tools » Planes\nStart » Help", 1),
    ("name;town;amount;date\nBolt;Kerby;12.50;2021-03-04\nNut;Marston;3.20;2021-03-05\nScrew;Kerby;7.00;2021-03-09", 1),
    ("Ort\tMenge\tPreis\nHafen\t12\t3,40\nMarkt\t7\t1,20\nMühle\t19\t8,75", 1),
    ("item            qty    price\nkettle            3    14.99\npan               1    29.50\nspoon            12     0.99", 1),
    ("2024-05-01T10:11:12Z INFO worker[311] queue=7 took=0.31\n2024-05-01T10:11:13Z WARN worker[311] queue=9 took=1.92", 1),
    ("width: 30 cm\nheight: 12 cm\nweight: 2 kg\ncolour: red\nstock: yes", 1),
    ("q83hFz0LmQ2vTnYp7sWkXcRb1uJdGe5oA9iHtN4y\nZx6VrMlP0qKsTgBw2EfUjYhCn8DaOi3kLm7pQrSt", 1),
    ("{{{{ //// ]]]] $$$$ %%%% #### x ~~~~ ^^^^ \\\\\\\\ ||||\n&&&& ==== ++++ ____ x >>>> <<<<", 1),
    ("Ã¶Ã¤â€™ Ã�Ã¶ €€ƒ ¶¶Ã� ™™â€ q Ã¤Ã¶Ã¼ x ƒ�¶", 1),
    ("sale sale SALE sale! sale, cheap sale sale SALE sale\nsale! sale sale, new sale", 1),
    ("xkcd wrtz pqmn bvcx. ghjk lmnp qrst\ntrzp mnbv wqkl xcvb", 1),
    ("Anna Berg | anna.berg@post.example | 030 1234567\nTom Wells | t.wells@post.example | 030 7654321", 1),
    ("lampe - 12,90\nchaise - 45,00\ntable - 120,00\narmoire - 310,00", 1),
    ("Mesa, 4, 120.5, Norte\nSilla, 16, 45.0, Sur\nArmario, 2, 310.9, Este", 1),
    ("The list below was never finished.\n- bolt\n- nut\n- washer\n- screw\n- nail\n- hook\n- hinge\n- bracket\n- spring\n- clip", 1),
    ("red;12;44;9.1\nblue;7;31;2.2\ngreen;19;4;8.8\nThis is the end of it.\nblack;3;77;1.5\nwhite;55;2;6.4", 1),
    ("Inicio | Tienda | Ayuda | Contacto\nInicio | Tienda | Libros | Mapas\nVolver", 1),
    ("- the old hammer\n- a small plane\n- the other saw\n- one long rasp\n- the clamp\n- a box of nails", 1),
    ("1) la silla blanca vieja\n2) el espejo grande\n3) una mesa redonda\n4) el cuadro de la abuela\n5) la alfombra", 1),
    ("(1) der rote Eimer\n(2) die lange Leiter\n(3) ein alter Besen\n(4) das neue Sieb", 1),
    ("â€“ une chaise\nâ€“ le grand miroir\nâ€“ la table ronde\nâ€“ un tapis", 1),
    ("- We left the house at dawn and walked along the river until we came to the mill.\n- The miller gave us bread and told us which way to take.\n- In the evening we reached the town.", 0),
    ("ERROR 17 disk0 full\nERROR 17 disk0 full\nERROR 18 disk1 full\nWARN 02 fan slow", 1),
]

#: Chunks sampled from a collection by the hash of their id and labelled by reading: those at even places calibrate, those at odd places measure.
SAMPLED: list[tuple[str, int]] = [
    ('Plane iron: our local glue line\nThe crooked hedge and a worn tunnel were both joined inside our second dew point. It was the jig that an old teacher marked beside every distant frost line every morning.', 0),
    ('Switch: another remote argument\nDoes this older port range carefully reach this distant packet beside one plain bridge? For this reason, a curious socket was closed through this quiet proxy and counted often.', 0),
    ('Argument: one curious script\r\nThe archive and this shallow alias were both carried before the rehearsal. Near Ravomere, one slow bulb replaces a local compost heap near the loop.', 0),
    ('Shard: the ordinary oak board\nThe saw blade is distant in Elsarcombe, but every plain footpath is not. What a trainee lifted without warning was the mount point across the border post.', 0),
    ('Quota: this nearest block device\r\nStill, our loose veneer was noticed at Joruford and lifted with some effort. If every rough quota is slow, then the hidden inode supports the snapshot quietly.', 0),
    ('Market hall: the steady charter\nYou can see how a broken score ignores the string section if the empty bow is lifted. Near Vesalness, the chronicle shapes the wildcard at Vesindale.', 0),
    ('Fenster: das helle Werkzeug\nDer Weg ist sauber, aber die offene Liste ist es nicht mit der stabile Fluss. Warum verbindet die offene Uhr eigentlich das leere Papier um das vergessene Ufer?', 0),
    ('Regards,\r\nProf. O. Harrerly\r\n95 Old Ferry Avenue, Lunucombe\r\nTel. (931) 555-0150\r\n Deliveries go to Flat 22, 53 Hazel Lane, Ardosthaven, not to the yard. The older part is that this steady seedling limits the flower bed in Selucombe.', 0),
    ('Après la pluie, le sentier usé contient un fichier étrange chez le marché rapide.\nCordialement,\nMme Corentin Cordieux\n+33 (0)1 99 00 80 36\n Étape 1. Est-ce que le jardin modeste change très tôt un cahier léger? À Ardumoor, une assiette fragile suit le clavier usé parmi la forêt rapide.', 0),
    ("Cordialement,\nÉlise Cordoisne\n+33 6 39 98 24 71\n C'est M. F. Lagroisne qui garde la clé. Registre: un dossier étroit\nIl y a 47 raisons pour que la récolte étrange reste utile depuis une échelle étrange. À\xa0Tavomness,\xa0le moulin ancien protège une échelle rapide chez un fichier ancien.", 0),
    ('Partition: the rough terminal\nYou can see how another second border post shapes the journal if one older chisel is moved. Even so, that older archive crosses a narrow lathe behind the terminal.', 0),
    ('Ventana: la lluvia tranquilo\n¿Por qué el puente antiguo retrasa dos veces una escalera gastado? Hay 22 razones para que la ventana rápido siga rápido hacia la colina lejano.', 0),
    ('Redirect: the hidden variable\nWhat a visitor borrowed with some effort was the root cutting near the empty tempo mark. Every worn score covers the narrow greenhouse, and the simple prompt carries the quota.', 0),
    ('Handshake: that older viaduct\nWhat the reviewer cleaned quietly was the inode near Galenness. Still, our empty pipeline protects a remote subnet beside this faulty resolver.', 0),
    ('Loop: that slow bass line\nThe partition and the backup were both borrowed before a slow graft. Near Lunommark, a quiet exit code delays the loop through the partition.', 0),
    ('Dew point: the worn pastry board\nWhat the keeper rebuilt every morning was the hedge near Kesilmark. The reviewer had 47 of them near Vesomgate, so the frost line was cleaned without warning. Near Dunilcombe, the greenhouse delays that temporary cloud bank around one reliable hedge.\n\nShare this page', 0),
    ('Every ordinary drum skin, which the surveyor copied after the mortise, splits the clean dovetail.Regards,\r\nOstington, Edith\r\nFlat 26, 59 Quarry Row, Nevurith\r\nTel. 01632 960610', 0),
    ('Muelle: la cosecha central\nHay 72 razones para que el pueblo gastado siga modesto después de la memoria tranquilo. ¿Por qué la orilla ligero sigue muy temprano el servidor sólido?', 0),
    ('Estante: el servidor extraño\nAl final, la cosecha antiguo alcanza un plano simple sobre la puerta extraño. ¿Por qué la orilla rápido abre dos veces el jardín central?', 0),
    ('Footpath: another reliable platform\nAfter a while this curious ticket office carries our ordinary map sheet behind this curious ticket office. It was the footpath that our group borrowed beside that heavy map sheet twice.', 0),
    ('Taller: la colina olvidado\n¿Por qué la puerta modesto contiene por último el pueblo vecino? La lluvia frágil es lejano, pero el servidor vecino no lo es cerca de el teclado simple.', 0),
    ('Watchtower: one empty variable\nIf the handshake is rough, then the prompt moves one small granary every morning. Near Kesincombe, the small overture repeats another plain tunnel beyond the slow overture.', 0),
    ('Contacto: Ximena Salcuelo, info@brightquay.example Cuaderno: un plano sólido\nEn Maroststead, una carta discreto cruza el teclado extraño entre un cuaderno tranquilo. La orden antiguo es frágil, pero un estante frágil no lo es con el registro olvidado. ¿Por qué la nieve frágil cruza a pesar del viento la cosecha útil?', 0),
    ('Saw blade: this borrowed mortise\nThe quiet part is that the curious jig improves our early firewall rule in Quelilstead. Nobody in Wesancombe found the clamp, though the reviewer sorted the tunnel usually.', 0),
    ('Wesomoor orden\nPelilcombe lámpara\nPlano\nMemoria\nMemoria\nRed\nPuente\nZelanwold lámpara\nOrden\nPelomfield plano\nRegistro\nPuente\nBelostead memoria\nMemoria\nLluvia', 1),
    ('teclado: 376\nplano: yes\nlluvia: Taverness\nsendero: 81\nteclado: Wesevstead\ncolina: Beloness\nescalera: 229\ncolina: no\nplano: 408\ncuaderno: Vesanmoor\ncarta: Jorincombe\nescalera: Ravermoor\ntaller: Lunenfield', 1),
    ('Desmond Quillabell\totis-osterly@lists.kelda.example\nWill Voldander\tgreta98@brightquay.example\nWill Ostander\ttobin.ostock@cordage.example.org', 1),
    ('Mr. Desmond Thackwicke | <mira39@cordage.example.org> | +44 7700 900413\nMs Hugh Brannander | office@lists.kelda.example\nIvy D. Brannock | otis.torrwicke@ponyexpress.example.net | 020 7946 0890', 1),
    ('Tobin Volderly\toffice@oakrow.invalid\nGreta Pembington\tinfo@cordage.example.org\t020 7946 0772\nEdith Fallow\tmailto:callum.ostabell@uni-hollen.test', 1),
    ('Harrerly, Edith;omerrerby@oakrow.invalid;01632 960745\nKellerly, Mark;office@uni-hollen.test;01632 960345\nMs J. Voldwicke;fkellwicke@oakrow.invalid\nThackwicke, Lyle;office@uni-hollen.test;020 7946 0507\nJasper M. Pembow;tpembabell@uni-hollen.test', 1),
    ('â™™ƒÃ™Ã a\n™¶¤ x ƒ¶�ÃÃ™ \n¶Ã�¤� q7 ™Ãâƒ¤ x ¶¤¶â¤â¶€� q7\nÃ�¤�â¤â�™Ã  â¤¤â�âƒ¶™ƒ€ a ™�¤� a\n™Ã€Ãâ¤â q7\n¤¶¶ƒââ¶™�¤â a ƒ¶€€ƒ�â q7\n¤¶â€€ x ¶™Ãâ�™ƒ¶¤€€ x �™¤€¶¤� a ƒâƒÃ™™™¤ q7 â™¶ƒ¤ƒâ a\n��™¶¤¶â a', 1),
    ('ridge trail: n/a\nferry: Veserdale\nborder post: no\nhostel: 485\nfootpath: n/a\ncable car: 791\nvalley road: 536', 1),
    ('$%\\\\$_###$$$$+++%%%///^^^^ x }}////#\\\\\\\\>] \\\\\\$~~]]]]====###>>>&]///>>>>^ x *&&&__^^^|||~~~~ x #%%%]]]]&&&{{[[ x $$$$\\||||&&&&//##+++++___\n//**]]]]___//~~~~$$$ x ////~~~~{{{{{>>%%%%****++[[>>>>>^^{~ {[[]]]]\\\\===_<$$$>>>>++##////>>', 1),
    ('€™â™�™â¤� x\n�€¶âƒƒ�� x ¤¤¶¶™�¤ q7\nâ�âÃ¶Ã a\nÃƒ™ÃÃ�ƒâ x\n™€€¤™¤¤ a €€ÃÃ¶¤€ q7\nÃ€¶��™â€ x Ã€��ââ€¤� q7 €â¶€ƒ¤ƒÃâ a\n¶¶�ƒƒ�  ¶Ã€€ a ™™â¤�ƒ¤™� q7 ¤¤ƒÃ��™™ƒÃ¶ q7\n�€™ƒ¶¤™  ¶€¤�ƒ€ƒ€€¶¶ƒ x\nƒ¶ÃâƒÃ€â™â™â  �¶ƒ¤�™™Ã€¤� q7', 1),
    ('colina: Duningate\narchivo: 518\nplano: no\ncuaderno: n/a\nventana: n/a\nventana: Quelinhaven\nmemoria: Quelencombe\nplano: 23\ncarta: no\ncosecha: 352\nsendero: Nevilford', 1),
    ('OTIS KELLABELL\toffice@brightquay.example\t+44 7700 900832\nFaye Osterly\tHOPE-KELLINGTON@CORDAGE.EXAMPLE.ORG\t(984) 555-0192\nWren Voldabell\tmark.ostington@cordage.example.org', 1),
    ('NORA PEMBOCK;tobin-thackerly @ fernpost.example;+44 7700 900689\nOtis Linnerly;mark45@solanum.example.com\nMr. L. Linnwicke;grace53@brightquay.example\nNora Merrabell;office@ponyexpress.example.net\nCallum Voldwicke;hope.quillerly+list@mail.tarnlink.test', 1),
    ('- el molino modesto\n- la colina húmedo\n- el puente simple\n- el puente antiguo\n- la memoria húmedo\n- la colina olvidado\n- una máquina estrecho\n- una escuela central\n- la cosecha frágil', 1),
    ('– every borrowed platform\n– one missing block device\n– another faulty subnet\n– the narrow bucket\n– every crooked map sheet\n– that ordinary loop\n– that ordinary loop\n– the forgotten disk image\n– the hidden history file\n– a hidden mountain hut', 1),
    ('1. the workbench borrowed\n2. one narrow chisel clean\n3. the cold front familiar\n4. the frost line missing\n5. the hidden proxy missing\n6. every borrowed port range broken\n7. our borrowed router reliable\n8. that faulty firewall rule narrow', 1),
    ('- la puerta modesto\n- una lámpara sólido\n- el registro estrecho\n- el molino antiguo\n- una carta rápido\n- un cuaderno vecino\n- el muelle húmedo\n- un plano modesto\n- el puente estrecho\n- la puerta discreto', 1),
    ('Switch | Packet | Link | Router | Resolver | Gateway | Port Range » Tunnel | Router | Socket | Switch » Packet | Dunevrith | Bridge | Tunnel | Holomgate\nYarandale | Maranhaven | Packet | Router | Holomstead | Feninford | Gateway', 1),
    ('™¤Ã�¶¶¶�€ q7 ƒ�â€â x Ã€Ã�¤€ƒƒ x Ã¤â¶€ x\n€¤¤ââ€ƒ� q7\n¤ƒâ¶™€ââ a â™Ã™™â™ x\n™¤Ã¶ÃÃÃ¤™  ¤�â™ x �Ãƒ¶€ƒ¶¶ƒ \n™ƒ™�â x\nƒ¶¤¶Ã¤ƒÃ€ââƒ a â™¤ \nâ¤¤€ÃÃ¶™™ a', 1),
    ('toll road: Ardenford\ntreaty: no\nmarket hall: 612\ncensus roll: Jorohaven\ntreaty: Coralford\ntoll road: yes\nferry crossing: no\nferry crossing: Belalford\ncharter: Zelinmere\ntoll road: no\ncharter: Vesendale\nwatchtower: 563', 1),
    ('Holercombe | Datei | Uhr | Belarfield | Garten » Liste | Zelinford | Speicher | Datei | Brücke | Werkzeug » Elsostwold | Uhr | Jorarrith | Jorenness | Weg\nFluss | Bahnhof | Karte | Dorf »', 1),
    ('Mortise\nElsanmoor mortise\nMortise\nClamp\nMaromby veneer\nIstevmere jig\nRasp\nChisel\nSaw Blade\nSaw Blade\nGlue Line\nIstanfield lathe\nIstalness lathe\nChisel\nGlue Line\nLathe\nMortise\nGlue Line\nClamp\nWesangate mortise\nMarerness lathe\nJig\nChisel\nMortise', 1),
    ('Hay\xa037\xa0razones para que el pueblo tranquilo siga rápido entre la lluvia modesto.', 0),
    ('One nearest granary is narrow against that slow charter, but every steady mill race is not.', 0),
    ('Nobody in Istandale joined the backup, though the reviewer found the partition with some effort.', 0),
    ('¿Por qué el muelle central supera despacio un archivo húmedo? Una lámpara rápido es discreto, pero el jardín simple no lo es hacia una escuela frágil.', 0),
    ('Near Zelingate, our simple fog layer explains that plain barometer across this shallow bulb.', 0),
    ('For this reason, it carries the workbench more than the barometer. A borrowed frost line is heavy beside that broken clamp, but the clamp is not. The temporary part is that the oak board covers the dovetail inside the glue line.', 0),
    ('Workbench: the clean flower bed\nThis simple bulb is small against the trellis, but every slow pruning saw is not. Fax: +44 7700 900573 / Office: +44 7700 900668 The plane iron and the rain gauge were both found against the bright thaw.', 0),
    ('Footpath: our broken footpath\nThe clerk had 83 of them outside Corumere, so the valley road was sorted before dawn. The cable car, which the archivist described under another faulty pruning saw, repeats the damp terminal.', 0),
    ('If the quiet bow is nearest, then the bow delays one broken rehearsal quietly. It was this n�rrow bow that the maintainer kept beside the distant ferry crossing once.', 0),
    ('Nobody in Holostgate copied that slow barometer, though the maintainer cleaned the stockpot by hand.', 0),
    ('Es gibt 76 Gründe, warum das nützliche Regal offen bleibt unter die Ernte.', 0),
    ('Does the pantry shelf in the end reach the rasp above the rough humidity reading?', 0),
    ('Does the stable score at first reach an early brine across the jig? At that point that quiet overture was sorted across the brine and painted in small steps. If our nearest ladle is small, then this worn skillet moves the spice jar on most days.', 0),
    ('À Holalhaven, une échelle discret ralentit la mémoire discret après le registre simple.', 0),
    ('This narrow seedling and one painted forecast were both found inside every empty rehearsal.', 0),
    ('If the slow parish book is borrowed, then the slow tunnel covers the faulty argument twice.', 0),
]
