from tapegrade.engine import main

main()
