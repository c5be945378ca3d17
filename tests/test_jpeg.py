import numpy as np
import pytest

from gridloom.functions import jpeg

Y, X = np.mgrid[0:50, 0:75]
SMOOTH = np.stack([np.sin(X / 9) * 90 + 128, np.cos(Y / 7) * 90 + 128, (X + Y) % 256], axis=-1).clip(0, 255).astype(np.uint8)
NOISE = np.random.default_rng(1).integers(0, 256, (33, 41, 3)).astype(np.uint8)
IMAGES = {"smooth": SMOOTH, "noise": NOISE, "gray": SMOOTH[:, :, :1], "flat": np.full((16, 16, 3), 77, dtype=np.uint8), "dot": np.full((1, 1, 1), 9, dtype=np.uint8), "steps": np.kron(NOISE[:8, :8], np.ones((6, 6, 1), dtype=np.uint8))}


def java_image(spark, data):
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    return image


@pytest.mark.parametrize("name", IMAGES)
@pytest.mark.parametrize("ycbcr", [False, True])
def test_round_trip(name, ycbcr):
    x = IMAGES[name]
    for quality, most in ((100, 2.0), (75, 25.0 if name != "noise" else 60.0)):
        back = jpeg.decode(jpeg.encode(x, ycbcr, quality), ycbcr)
        assert back.shape == x.shape and np.abs(back.astype(int) - x).mean() <= most


def test_another_decoder_sees_the_same(spark):
    for x in (SMOOTH, NOISE, IMAGES["steps"]):
        data = jpeg.encode(x, True, 90)
        image, own = java_image(spark, data), jpeg.decode(data, True)
        assert (image.getHeight(), image.getWidth()) == x.shape[:2]
        for r, c in [(0, 0), (7, 8), (20, 31), (x.shape[0] - 1, x.shape[1] - 1)]:
            v = image.getRGB(c, r) & 0xFFFFFF
            assert np.abs(np.array([v >> 16, v >> 8 & 255, v & 255]) - own[r, c].astype(int)).max() <= 3


def test_subsampled_images_of_another_encoder(spark):
    """Images of another encoder, with chroma at half the size."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(75, 50, 1)
    for r in range(50):
        for c in range(75):
            image.setRGB(c, r, int(SMOOTH[r, c, 0]) << 16 | int(SMOOTH[r, c, 1]) << 8 | 100)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    got = jpeg.decode(bytes(out.toByteArray()), True)
    assert got.shape == (50, 75, 3) and np.abs(got[:, :, :2].astype(int) - SMOOTH[:, :, :2]).mean() < 6


def test_damage_is_told():
    data = jpeg.encode(SMOOTH)
    for bad in (b"\xff\xd8", data[:200], data[: len(data) // 2], b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x10\x00\x10\x01\x01\x11\x00"):
        with pytest.raises(ValueError):
            jpeg.decode(bad)
