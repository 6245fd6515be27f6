"""Canonical SHA-256 digests, lengths and openings (see licenses) of full licence texts and their headers, with and without what follows their terms."""

# Fixed values.
FULL = [
    ("c8d2aa544a47107a1313326d08631799d7732b4ea61f56a31a3092142a95dd37", "Apache-2.0", 9877, "apache license version 2"),
    ("9fc9703e9f4c780abb419bca43131c49399bd4bc3a2e040e5b889bc8650d1af7", "Apache-2.0", 499, "licensed under the apach"),
    ("fcff9f39384705eddb53addb4c30e20271bb4e751417c0482f7bcec65e0ceca3", "Apache-2.0", 8835, "apache license version 2"),
    ("520f1660d9cc2aee779967d9f3f165c2229677ca38ca486a04c955a4f878c3e6", "Apache-2.0", 8863, "apache license version 2"),
    ("bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93", "Artistic-1.0-Perl", 5823, "the artistic license pre"),
    ("cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e", "CC0-1.0", 6691, "creative commons legal c"),
    ("6f32861f21e5278d37d121f29164b0252c7e86793889a15a794f8a263e6a6ab9", "GFDL-1.2", 19530, "gnu free documentation l"),
    ("55b938849c5cf5ded2d3482d388e9d8a484a04d7308777a22ce1850cf64910e0", "GFDL-1.3", 21998, "gnu free documentation l"),
    ("38e3a35959fa4735cd867e5fe8e8f5d183f5a19d771360189b83e89391ef7950", "GPL-1.0", 9360, "gnu general public licen"),
    ("fa1b93b156e883eaa26a21fbac7fe35b628bbd257d06cdbe4e86ee0ab7f9fc2c", "GPL-1.0", 9332, "gnu general public licen"),
    ("9693d9c49505c77f5e2a6a90436178e648c72bef53f436c20b7fc58964bbe663", "GPL-1.0", 11608, "gnu general public licen"),
    ("3606e919f92e4862a5628788f284c07f5a0ca41b819f88414d7e825dca4facc4", "GPL-2.0", 657, "this program is free sof"),
    ("69e3aca8a579235487bbf58b38ed284d3f21160a31bd19d181b094a92f02acb4", "GPL-2.0", 14395, "gnu general public licen"),
    ("6186c2b9e1fbbfe994a454357b050eab51d49760436171460ff3d09dc6877fd1", "GPL-2.0", 14423, "gnu general public licen"),
    ("a9c74da533fd858534f1b08c8d8a63831d2d8cc92440752bf8f8980cd41dea9f", "GPL-2.0", 16955, "gnu general public licen"),
    ("8f22d2ddca4a1c3ee73f1077f59a161b4fd2f7ae080d2abaf4394ff0c9a2120d", "GPL-3.0", 33366, "gnu general public licen"),
    ("7ffc4b405b2d22c9a01c3a22db88495dbca721fad42a69191637c049f0108153", "GPL-3.0", 30929, "gnu general public licen"),
    ("3e0639e2a9692446a12737e1e8a22455de0cf05c81a22cf39ea6cc1d2e85581b", "GPL-3.0", 590, "this program is free sof"),
    ("4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b", "GPL-3.0", 30957, "gnu general public licen"),
    ("5ca4718fa3c5d8f13b6eba5034273a44e7fef83cc37e1b5ef87856eb562f184e", "LGPL-2.0", 22217, "gnu library general publ"),
    ("1ddaa6827889f0eb9f917db297bc065e3af84df5638230d69b3cf1a1f28c1da9", "LGPL-2.0", 22189, "gnu library general publ"),
    ("07ea55842178b65d9e7ee1bbf398dda46d3f1ae7036217e299c0d5ef1eab3649", "LGPL-2.0", 24070, "gnu library general publ"),
    ("51d50a2196491ba81648d8d09aa62ccd2d644f63f7d0f0ce90d473c641fb2010", "LGPL-2.1", 23305, "gnu lesser general publi"),
    ("38fd334a43235dc3cc9b4054ff7eda2187759f1748f276e846fe99c0d3225c0f", "LGPL-2.1", 680, "this library is free sof"),
    ("c6adbc90553e057888fc5f7f8b6a91df3cab12ffa33d0072031f641fc54954d0", "LGPL-2.1", 23277, "gnu lesser general publi"),
    ("2edbc90847a6ddf5651b29a800076db76eb12973e92d3076c52492d9a9b06772", "LGPL-2.1", 25157, "gnu lesser general publi"),
    ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "LGPL-3.0", 7104, "gnu lesser general publi"),
    ("4be4a6251869e153404f424bbd1c116ada60f8969d5610b406e2a430e206b0bc", "MPL-1.1", 22436, "mozilla public license v"),
    ("9fa7c9fda45a669fc40b0488535dca76ad4c9b85046f0acf8944aff812e0f530", "MPL-2.0", 14337, "mozilla public license v"),
    ("7d1bf2e98ce3532adf5b45ef8a8ec1944f1b8f5af9760ce3420ff551d298d971", "MPL-2.0", 13657, "mozilla public license v"),
    ("7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd", "Unlicense", 1171, "this is free and unencum"),
]
