"""Opening names by the moves from the start."""

#: Moves in SAN and the opening's name.
OPENINGS = {
    "e4": "Khai cuộc tốt vua (1.e4)",
    "d4": "Khai cuộc tốt hậu (1.d4)",
    "c4": "Khai cuộc Anh",
    "Nf3": "Khai cuộc Réti",
    "e4 c5": "Phòng thủ Sicilia",
    "e4 e6": "Phòng thủ Pháp",
    "e4 c6": "Phòng thủ Caro-Kann",
    "e4 d5": "Phòng thủ Scandinavia",
    "e4 d6": "Phòng thủ Pirc",
    "e4 g6": "Phòng thủ hiện đại",
    "e4 Nf6": "Phòng thủ Alekhine",
    "e4 e5": "Ván cờ mở",
    "e4 e5 f4": "Gambit vua",
    "e4 e5 Nf3 d6": "Phòng thủ Philidor",
    "e4 e5 Nf3 Nf6": "Phòng thủ Nga (Petrov)",
    "e4 e5 Nf3 Nc6": "Ván cờ mở, 2...Mc6",
    "e4 e5 Nf3 Nc6 Bb5": "Khai cuộc Tây Ban Nha (Ruy Lopez)",
    "e4 e5 Nf3 Nc6 Bc4": "Khai cuộc Ý",
    "e4 e5 Nf3 Nc6 d4": "Ván cờ Scotch",
    "e4 e5 Nc3": "Ván cờ Viên",
    "d4 d5": "Khai cuộc tốt hậu, 1...d5",
    "d4 d5 c4": "Gambit hậu",
    "d4 d5 c4 e6": "Gambit hậu từ chối",
    "d4 d5 c4 dxc4": "Gambit hậu chấp nhận",
    "d4 Nf6": "Phòng thủ Ấn Độ",
    "d4 Nf6 c4 g6": "Phòng thủ Ấn Độ cổ",
    "d4 Nf6 c4 e6": "Hệ thống Ấn Độ hậu",
    "d4 Nf6 c4 e6 Nc3 Bb4": "Phòng thủ Nimzo-Ấn Độ",
    "d4 f5": "Phòng thủ Hà Lan",
}
